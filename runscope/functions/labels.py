"""Run labels, stamps, commands and paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LABEL_PARTS = ("benchmark", "runtime_config", "run_name", "fpga_config")

# fixed values: the three stamp styles
STAMP_STYLES = {"run": "%Y-%m-%d%H%M%S", "report": "%Y-%m-%d-%H%M%S", "day": "%Y%m%d"}
_STAMP_SHAPES = {
    "run": (r"\A(\d{4}-\d\d-\d\d)(\d\d)(\d\d)(\d\d)\z", "$1 $2:$3:$4"),
    "report": (r"\A(\d{4}-\d\d-\d\d)-(\d\d)(\d\d)(\d\d)\z", "$1 $2:$3:$4"),
    "day": (r"\A(\d{4})(\d\d)(\d\d)\z", "$1-$2-$3 00:00:00"),
}


def hue_split(hue: Column) -> list[Column]:
    """``program.runtime.run_config.fpga`` as four columns; a missing part is NULL."""
    parts = F.split(hue, r"\.")
    return [F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(LABEL_PARTS)]


def hue_compose(program: Column, runtime: Column, run_config: Column, fpga: Column) -> Column:
    """The four parts as one label."""
    return F.concat_ws(".", program, runtime, run_config, fpga)


def metric_name(token_name: Column, mode: str = "token") -> Column:
    """Metric name of a log token.

    ``token`` keeps the second underscore-separated part (metrics may collide, the last one
    wins later on); ``full`` keeps everything after the first underscore.
    """
    if mode == "token":
        kept = F.get(F.split(token_name, "_"), F.lit(1))
    elif mode == "full":
        kept = F.regexp_replace(token_name, r"\A[^_]*_", "")
    else:
        raise ValueError(f"unknown name mode: {mode}")
    return F.lower(kept)


def run_stamp(stamp: Column, style: str = "run") -> Column:
    """Format a naive timestamp. Built from its text form, so no time zone takes part."""
    text = F.substring(stamp.cast("timestamp_ntz").cast("string"), 1, 19)
    day, clock = F.substring(text, 1, 10), F.replace(F.substring(text, 12, 8), F.lit(":"), F.lit(""))
    if style == "run":
        return F.concat(day, clock)
    if style == "report":
        return F.concat(day, F.lit("-"), clock)
    if style == "day":
        return F.replace(day, F.lit("-"), F.lit(""))
    raise ValueError(f"unknown stamp style: {style}")


def parse_stamp(text: Column, style: str = "run") -> Column:
    """P8, the inverse: TIMESTAMP_NTZ, or NULL when the text is not a stamp of that style."""
    shape, spaced = _STAMP_SHAPES[style]
    return F.when(
        text.rlike(shape), F.regexp_replace(text, shape, spaced)
    ).try_cast("timestamp_ntz")


def command_text(cmd: Column, sep: str | None = None) -> Column:
    """Script text of a command; NULL when there is none (an interactive run).

    Without ``sep`` the command is a string already; with it, an array to be joined.
    """
    text = cmd if sep is None else F.array_join(cmd, sep)
    return F.when(text != "", text)


def is_interactive(cmd: Column) -> Column:
    return F.coalesce(cmd == "", F.lit(True))


def job_kind(cmd: Column, run_name: Column) -> list[Column]:
    """P10: whether a run is interactive, and its job name."""
    interactive = is_interactive(cmd)
    return [
        interactive.alias("interactive"),
        F.when(interactive, F.concat(run_name, F.lit("-interactive"))).otherwise(run_name).alias("job_name"),
    ]


def result_path(series: Column, name: Column, config: Column, root: str = "results") -> Column:
    """Place of a run in the results tree."""
    return F.concat(F.lit(root + "/"), series, F.lit("/"), name, F.lit("/"), config, F.lit("/"))


def log_path(template: Column, job_id: Column) -> Column:
    """Scheduler log path with the job id filled in."""
    return F.replace(template, F.lit("%j"), job_id.cast("string"))
