"""Counter CSV files as long, ordered samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from runscope.formats import CYCLES, DATA_LINE, DROPPED_COLUMNS, HEADER_LINE
from runscope.joins import BROADCAST_BYTES, join_per_key
from runscope.operators.series import let, steps
from runscope.session import fresh_path, written
from runscope.sources.logs import is_run, line_columns, run_of, text_of
from runscope.sources.texts import listed_texts, text_lines, whole_texts

# Files up to this size are parsed whole, without any shuffle; larger ones are split by line.
WHOLE_FILE_BYTES = 64 * 1024 * 1024

# Why a cell has no value: the record has another number of cells than the header, it is empty, or no number.
REASONS = ("cells", "empty", "number")

_INTEGER = r"\A[ \t]*[+-]?[0-9]+[ \t]*\z"
_NUMBER = r"\A[ \t]*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?[ \t]*\z"
# A cell that begins with a quote is quoted up to the next single quote, commas and newlines included; a quote
# further on in a cell is a character as any other. Possessive, so that matching takes linear time.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+(?:"|\z)'
# a comma and the cell after it
_CELL = rf',({_QUOTED}[^,]*+|[^,]*+)'
# a record and its line end
_RECORD = rf'([^"\r\n]*+(?:(?:(?<=[,\r\n]|\A){_QUOTED}|")[^"\r\n]*+)*+)(?:\r\n|\r|\n|\z)'
# a whole quoted cell at the begin of a line or after a comma, and the begin of one that is left
_CLOSED, _OPEN = r'(?<=,|\A)"[^"]*+(?:""[^"]*+)*+"', r'(?:,|\A)"'
# A record of more lines, as an unclosed quote makes it, is never one text: its cells are found line by line.
RECORD_LINES = 10_000
# Lines of such a cell that are put together at a time.
TEXT_LINES = 4096


def _blank(line: Column) -> Column:
    """Whether a line has only spaces and tabs; the common cases need no look at all of it."""
    rest = F.ltrim(line)
    return (rest == "") | (rest.startswith("\t") & (F.trim(line, F.lit(" \t")) == ""))


def _unquoted(cell: Column) -> Column:
    return F.replace(F.regexp_replace(cell, r'(?s)\A"(.*)"\z', "$1"), F.lit('""'), F.lit('"'))


def _cells(line: Column) -> Column:
    """Cells of one CSV record; quotes may enclose commas, doubled quotes stand for one."""
    quoted = F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), F.lit(1)), _unquoted)
    return F.when(line.contains('"'), quoted).otherwise(F.split(line, ","))


def _column_names(cells: Column) -> Column:
    """Names in a header's cells; an empty one gets its position."""
    return F.transform(
        cells,
        lambda c, i: F.when(c == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(c),
    )


def _unique_names(names: str) -> Column:
    """An array column's names, a repeated one with ``.1``, ``.2``, … appended.

    Numbers whose name the header already has are passed over.
    """

    def unique(name: Column, i: Column) -> Column:
        repeat = F.size(F.filter(F.slice(names, F.lit(1), i), lambda other: other == name))
        free = F.filter(
            F.transform(
                F.sequence(F.lit(1), F.size(names) * 2),
                lambda n: F.concat(name, F.lit("."), n.cast("string")),
            ),
            lambda candidate: ~F.array_contains(names, candidate),
        )
        return F.when(repeat == 0, name).otherwise(F.get(free, repeat - 1))

    return F.transform(names, unique)


def _count(cell: Column) -> Column:
    """Integer value of a cell: fractions truncate, anything that is no finite number is NULL.

    The patterns come first because a failing cast is many times slower than a match.
    """
    return F.when(
        cell.rlike(_INTEGER),
        F.coalesce(cell.try_cast("bigint"), cell.try_cast("double").try_cast("bigint")),
    ).when(cell.rlike(_NUMBER), cell.try_cast("double").try_cast("bigint"))


def _samples(records: DataFrame, drop: Sequence[str], cycles: str, strict: bool, passed_on: Sequence[str] = (), reasons: bool = False) -> DataFrame:
    """``records(run_id, sample_idx, header, line)`` → one row per sample and counter; ``reasons``: why a cell has no value."""
    split = records.select(
        "run_id", "sample_idx", "header", *passed_on, _cells(F.col("line")).alias("cells")
    )
    whole = F.size("cells") == F.size("header")
    cell = F.when(whole, F.get("cells", F.col("i")))
    cycle_cell = F.when(whole, F.get("cells", F.array_position("header", F.lit(cycles)).cast("int") - 1))
    cells = (
        split.withColumn("cycles", _count(cycle_cell))
        .select("run_id", "sample_idx", "cycles", "cells", "header", *passed_on, F.posexplode_outer("header").alias("i", "counter"))
        .where(F.col("counter").isNotNull() & ~F.col("counter").isin(*drop))
        .select("run_id", "sample_idx", "cycles", "counter", *passed_on, cell.alias("cell"), whole.alias("whole"))
    )
    return _valued(cells, _count(F.col("cell")), strict, passed_on, reasons)


def _valued(cells: DataFrame, value: Column, strict: bool, passed_on: Sequence[str], reasons: bool) -> DataFrame:
    """``cells(run_id, sample_idx, cycles, counter, cell, whole)`` → samples; ``whole``: the record has a cell per column."""
    if strict:
        complaint = F.concat(
            F.lit("bad counter cell in run "), F.col("run_id").cast("string"),
            F.lit(", sample "), F.col("sample_idx").cast("string"), F.lit(", "), F.col("counter"),
        )
        value = F.coalesce(value, F.raise_error(complaint).cast("bigint"))
    samples = cells.select("run_id", "sample_idx", "cycles", "counter", value.alias("value"), *passed_on, *(["cell", "whole"] if reasons else []))
    if not reasons:
        return samples
    why = F.when(~F.col("whole"), REASONS[0]).when(F.trim("cell", F.lit(" \t")) == "", REASONS[1]).otherwise(REASONS[2])
    return samples.withColumn("reason", F.when(F.col("value").isNull(), why)).drop("whole")


def _records_of(text: Column) -> Column:
    """Records of a CSV text; only one with quotes needs more than its lines."""
    return F.when(text.contains('"'), F.regexp_extract_all(text, F.lit(_RECORD), F.lit(1))).otherwise(F.split(text, r"\r\n|\r|\n"))


def _ends_inside(line: Column) -> Column:
    """Whether a line that begins outside of quotes ends inside of them."""
    return line.contains('"') & F.regexp_replace(line, _CLOSED, "").rlike(_OPEN)


def record_parts(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Which lines make a record: ``lines(path, block, seq, value)`` → plain ones, parts of records, and long records.

    The plain lines are a record each; a part has the place of the line that its record begins with, ``head``, and whether
    it begins and ends inside of quotes. Records of more than ``RECORD_LINES`` lines are long; see :func:`_numbered`.

    Whether a line begins inside of quotes depends on all lines before it. So each line is taken both ways,
    as if it began outside and as if inside; a line either ends the same way for both or passes the way on,
    as it was or turned round. Within a split those steps are composed by one window, the splits by another over
    one row each, which then tells all lines their true state.
    """
    value = F.col("value")
    in_split = Window.partitionBy("path", "block").orderBy("seq")
    before = in_split.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    # the state after a line: `sure`, or else that before it, turned round if `turns`
    stepped = lines.withColumns({"out": _ends_inside(value), "in": _ends_inside(F.concat(F.lit('"'), value)) | ~value.contains('"')})
    stepped = stepped.withColumns({"sure": F.when(F.col("out") == F.col("in"), F.col("out")), "turns": F.when(F.col("out") & ~F.col("in"), 1).otherwise(0)})

    def followed(rows: DataFrame, window, names: dict[str, str]) -> DataFrame:
        """The same two over all rows before each."""
        total = F.coalesce(F.sum("turns").over(window), F.lit(0))
        at_sure = F.struct(F.col("sure"), (F.sum("turns").over(window.rowsBetween(Window.unboundedPreceding, 0))).alias("turned"))
        last = F.last(F.when(F.col("sure").isNotNull(), at_sure), ignorenulls=True).over(window)
        odd = F.pmod(total - F.coalesce(last["turned"], F.lit(0)), F.lit(2)) == 1
        return rows.withColumns({names["sure"]: F.when(last.isNotNull(), last["sure"] != odd), names["turns"]: odd})

    # written: what follows reads it for the splits, the plain lines and the others
    inner = written(followed(stepped, before, {"sure": "sure_before", "turns": "turned_before"}), "line-states")
    # a split as one step: what its last line says of the state behind it
    behind = F.when(F.col("sure").isNotNull(), F.col("sure")).otherwise(F.col("sure_before") != (F.col("turns") == 1))
    turned = F.when(F.col("sure").isNotNull(), F.lit(False)).otherwise(F.col("turned_before") != (F.col("turns") == 1))
    splits = inner.groupBy("path", "block").agg(F.max_by(F.struct(behind.alias("sure"), F.when(turned, 1).otherwise(0).alias("turns")), "seq").alias("s"))
    splits = followed(splits.select("path", "block", "s.*"), earlier, {"sure": "split_sure", "turns": "split_turned"})
    starts = splits.select("path", "block", F.coalesce("split_sure", "split_turned").alias("begins_inside"))
    known = inner.join(starts, ["path", "block"])
    inside = F.coalesce(F.col("sure_before"), F.col("begins_inside") != F.col("turned_before"))
    known = known.withColumn("inside", inside).withColumn("ends_inside", F.when(F.col("inside"), F.col("in")).otherwise(F.col("out")))
    plain = known.where(~F.col("inside") & ~F.col("ends_inside")).select("path", "block", "seq", "value")

    # the others by the line their record begins with: in the same split, or the last begun in an earlier one
    parts = known.where("inside or ends_inside")
    begin = F.when(~F.col("inside"), F.struct("block", "seq"))
    here = F.last(begin, ignorenulls=True).over(in_split.rowsBetween(Window.unboundedPreceding, 0))
    last_begun = parts.groupBy("path", "block").agg(F.max(begin).alias("last"))
    carried = last_begun.select("path", "block", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    parts = parts.withColumn("here", here).join(carried, ["path", "block"]).withColumn("head", F.coalesce("here", "carried"))
    parts = written(parts.select("path", "head", "block", "seq", "value", "inside", "ends_inside"), "record-parts")
    long = written(parts.groupBy("path", "head").agg(F.count("*").alias("n")).where(F.col("n") > RECORD_LINES).select("path", "head"), "long-records")
    return plain, parts, None if long.isEmpty() else _numbered(parts, long)


def join_lines(lines: DataFrame) -> DataFrame:
    """Records over several lines as one: ``lines(path, block, seq, value)`` → the same with whole records.

    Only of a ``long`` record, of more than ``RECORD_LINES`` lines, ``value`` is no more than its first lines, which show that
    it is there and where; :func:`counter_scan_lines` takes all of its cells from the lines themselves.
    """
    return _joined(*record_parts(lines))


def _joined(plain: DataFrame, parts: DataFrame, long: DataFrame | None) -> DataFrame:
    """:func:`join_lines` on what :func:`record_parts` told. Plain lines, nearly all, go on as they are."""
    begun = parts.select("path", "head", "block", "seq", "value", F.lit(False).alias("long"))
    if long is not None:
        heads = F.broadcast(long.where("nth = 1").select("path", "head"))
        first = long.where(F.col("nth") <= RECORD_LINES).select("path", "head", "block", "seq", "value", F.lit(True).alias("long"))
        begun = begun.join(heads, ["path", "head"], "left_anti").unionByName(first)
    lines = F.array_sort(F.collect_list(F.struct("block", "seq", "value")))
    joined = begun.groupBy("path", "head", "long").agg(F.transform(lines, lambda line: line["value"]).alias("lines"))
    joined = joined.select("path", "head.block", "head.seq", F.array_join("lines", "\n").alias("value"), "long")
    return plain.withColumn("long", F.lit(False)).unionByName(joined)


def _pieces() -> Column:
    """What a line of a record has of each cell, quotes and all; a line that begins inside of them goes on with a cell."""
    found = F.regexp_extract_all(F.concat(F.when(F.col("inside"), ',"').otherwise(","), "value"), F.lit(_CELL), F.lit(1))
    # without the quote that was put before
    found = F.transform(found, lambda c, i: F.when(F.col("inside") & (i == 0), F.substr(c, F.lit(2))).otherwise(c))
    return F.when(F.col("inside") & ~F.col("value").contains('"'), F.array("value")).otherwise(found)


def _numbered(parts: DataFrame, heads: DataFrame) -> DataFrame:
    """The lines of long records, with their number in the record, ``nth``, and that of the cell they begin in, ``at``.

    ``cells`` is how many the record has. Lines and cells are counted per split, the splits by one row each, so that
    a record may have any share of all lines.
    """
    lines = parts.join(F.broadcast(heads), ["path", "head"], "left_semi").withColumn("more", F.size(_pieces()) - 1)
    split = ["path", "block", "head"]
    in_split, record = Window.partitionBy(*split).orderBy("seq"), Window.partitionBy("path", "head")
    earlier = record.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy(*split).agg(F.count("*").alias("n"), F.sum("more").alias("m")).select(
        *split,
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("lines_before"),
        F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("cells_before"),
        (F.sum("m").over(record) + 1).alias("cells"),
    )
    nth = F.row_number().over(in_split) + F.col("lines_before")
    at = F.coalesce(F.sum("more").over(in_split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("cells_before")
    return written(lines.join(splits, split).withColumns({"nth": nth, "at": at}).drop("more", "lines_before", "cells_before"), "long-lines")


def _long_cells(long: DataFrame, wanted: DataFrame, texts: bool) -> DataFrame:
    """Cells of long records: ``wanted(path, head, places)`` → ``(path, head, i, cell, value)``.

    ``places`` are the numbers of the cells that are wanted, NULL for all. A cell of several lines is no number, so only with
    ``texts`` it is there at all: put together from ``TEXT_LINES`` at a time, and then from those.
    """
    pieces = long.join(wanted, ["path", "head"]).withColumn("pieces", _pieces())
    pieces = pieces.select("path", "head", "block", "seq", "at", "inside", "ends_inside", "places", F.size("pieces").alias("n"), F.posexplode("pieces").alias("j", "piece"))
    pieces = pieces.withColumn("i", F.col("at") + F.col("j")).where(F.col("places").isNull() | F.array_contains("places", F.col("i")))
    one_line = (~F.col("inside") | (F.col("j") > 0)) & (~F.col("ends_inside") | (F.col("j") < F.col("n") - 1))
    cells = pieces.where(one_line).select("path", "head", "i", _unquoted(F.col("piece")).alias("cell"))
    cells = cells.withColumn("value", _count(F.col("cell")))
    if not texts:
        return cells

    def text(*order: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "piece"))), lambda p: p["piece"]), "\n").alias("piece")

    several = pieces.where(~one_line).withColumn("chunk", F.floor(F.col("seq") / TEXT_LINES))
    several = several.groupBy("path", "head", "i", "block", "chunk").agg(text("seq")).groupBy("path", "head", "i").agg(text("block", "chunk"))
    # as `_unquoted`, but a cell may be as large as a row can be
    closed = F.startswith("piece", F.lit('"')) & F.endswith("piece", F.lit('"')) & (F.length("piece") > 1)
    cell = F.when(closed, F.substr("piece", F.lit(2), F.length("piece") - 2)).otherwise(F.col("piece"))
    return cells.unionByName(several.select("path", "head", "i", F.replace(cell, F.lit('""'), F.lit('"')).alias("cell"), F.lit(None).cast("bigint").alias("value")))


def _long_samples(rows: DataFrame, long: DataFrame, drop: Sequence[str], cycles: str, strict: bool, passed_on: Sequence[str], reasons: bool) -> DataFrame:
    """:func:`_samples` of long records, ``rows(path, block, seq, run_id, sample_idx, header)``, a row per cell all the way."""
    cycles_at = F.array_position("header", F.lit(cycles)) - 1
    places = F.filter(F.sequence(F.lit(0).cast("bigint"), F.size("header") - F.lit(1).cast("bigint")), lambda j: ~F.get("header", j.cast("int")).isin(*drop) | (j == cycles_at))
    sizes = long.where("nth = 1").select("path", "head", "cells")
    rows = rows.withColumn("head", F.struct("block", "seq")).join(sizes, ["path", "head"])
    rows = written(rows.withColumns({"whole": F.col("cells") == F.size("header"), "cycles_at": cycles_at, "places": places}), "long-samples")
    cells = written(_long_cells(long, rows.where("whole").select("path", "head", "places"), reasons), "long-cells")
    of_cycles = cells.select("path", "head", F.col("i").alias("cycles_at"), F.col("value").alias("cycles"))
    exploded = (
        rows.join(of_cycles, ["path", "head", "cycles_at"], "left")
        .select("path", "head", "run_id", "sample_idx", "cycles", "whole", *[c for c in passed_on if c != "path"], F.posexplode_outer("header").alias("i", "counter"))
        .where(F.col("counter").isNotNull() & ~F.col("counter").isin(*drop))
        .withColumn("i", F.col("i").cast("bigint"))
    )
    return _valued(exploded.join(cells, ["path", "head", "i"], "left"), F.col("value"), strict, passed_on, reasons)


def _bodies(files: DataFrame, header_line: int, data_line: int) -> DataFrame:
    """Whole files as ``(run_id, header, body)``: column names, and the records that are samples."""
    # the line reader drops a byte order mark, so this one must
    text = F.when(F.startswith("value", F.lit("\ufeff")), F.substr("value", F.lit(2))).otherwise(F.col("value"))
    return (
        files.select("run_id", _records_of(text).alias("lines"))
        .select(
            "run_id",
            _column_names(_cells(F.get("lines", F.lit(header_line)))).alias("names"),
            F.filter(
                F.slice("lines", F.lit(data_line + 1), F.size("lines")), lambda line: ~_blank(line)
            ).alias("body"),
        )
        .select("run_id", _unique_names("names").alias("header"), "body")
    )


def counter_lines(
    files: DataFrame, header_line: int = HEADER_LINE, data_line: int = DATA_LINE, drop: Sequence[str] = DROPPED_COLUMNS
) -> DataFrame:
    """The samples of whole files as ``(run_id, counters, lines)``, for :func:`runscope.operators.series.steps`.

    A file without a header has NULL counters, hence no samples. A filter on that would be pushed below the parsing.
    """
    places = F.filter(F.sequence(F.lit(0), F.size("header") - 1), lambda j: ~F.get("header", j).isin(*drop))

    def values(line: Column) -> Column:
        return let(
            _cells(line),
            lambda cells: F.when(F.size(cells) == F.size("header"), F.transform("places", lambda j: _count(F.get(cells, j)))).otherwise(
                F.array_repeat(F.lit(None).cast("bigint"), F.size("places"))
            ),
        )

    bodies = _bodies(files, header_line, data_line).withColumn("places", places)
    counters = F.transform("places", lambda j: F.get("header", j))
    return bodies.select("run_id", counters.alias("counters"), F.transform("body", values).alias("lines"))


def counter_scan(
    files: DataFrame,
    header_line: int = HEADER_LINE,
    data_line: int = DATA_LINE,
    drop: Sequence[str] = DROPPED_COLUMNS,
    cycles: str = CYCLES,
    strict: bool = False,
    reasons: bool = False,
) -> DataFrame:
    """``files(run_id, value)`` → ``(run_id, sample_idx, cycles, counter, value)``.

    ``value`` is the text of one file. The counter set may differ per file, hence the long
    form; each row also carries its sample's cycle count, so that seconds need no join later.
    ``sample_idx`` counts the non-blank data lines from 0. Records whose cell count differs
    from the header's, and cells that are no number, give NULL, or an error when ``strict``.
    A quoted cell may hold newlines; header and data line count records. All of it is row-local: no shuffle.
    """
    records = (
        _bodies(files, header_line, data_line)
        .select("run_id", "header", F.posexplode_outer("body").alias("nth", "line"))
        .where(F.col("line").isNotNull())
        .select("run_id", F.col("nth").cast("bigint").alias("sample_idx"), "header", "line")
    )
    return _samples(records, drop, cycles, strict, reasons=reasons)


def counter_scan_lines(
    lines: DataFrame,
    header_line: int = HEADER_LINE,
    data_line: int = DATA_LINE,
    drop: Sequence[str] = DROPPED_COLUMNS,
    cycles: str = CYCLES,
    strict: bool = False,
    reasons: bool = False,
    passed_on: Sequence[str] = (),
) -> DataFrame:
    """The same for files too large for one row: ``lines(path, block, seq, value)``.

    ``(block, seq)`` orders the lines of a file: the split they came from and their order in it.
    ``lines`` is read more than once and must not change in between, so pass a written table.
    A line's number is its place within the split plus the lines of the splits before it. All
    lines are distributed by (path, block), which no file size makes uneven. Files in which a quoted cell holds
    a newline first get their records together, see :func:`join_lines`; a record of any number of lines has all its cells.
    """
    long = None
    if not lines.where(_ends_inside(F.col("value"))).isEmpty():
        plain, parts, long = record_parts(lines)
        lines = written(_joined(plain, parts, long), "records")
    filled = ~_blank(F.col("value"))
    in_split = (
        Window.partitionBy("path", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    )
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("path").orderBy("block", "seq")
    is_header = F.col("nth") == header_line + 1
    first_lines = (
        lines.withColumn("nth", F.row_number().over(in_file))
        .where(F.col("nth") <= max(data_line, header_line + 1))
        .groupBy("path")
        .agg(
            F.max(F.when(is_header, F.col("value"))).alias("header_text"),
            F.count_if((F.col("nth") <= data_line) & filled).alias("not_samples"),
            *([] if long is None else [F.max(F.when(is_header & F.col("long"), F.struct("block", "seq"))).alias("head")]),
        )
    )
    names = _cells(F.col("header_text"))
    if long is not None:
        # a long header is read only where it is one of samples, as an unclosed quote may make all of a file its header
        totals = lines.groupBy("path").agg(F.count_if(filled).alias("filled"))
        wanted = first_lines.where("head is not null").join(totals, "path").where("filled > not_samples")
        header_cells = _long_cells(long, wanted.select("path", "head", F.lit(None).cast("array<bigint>").alias("places")), texts=True)
        in_order = F.array_sort(F.collect_list(F.struct("i", "cell")))
        header_cells = header_cells.groupBy("path").agg(F.transform(in_order, lambda c: c["cell"]).alias("long_header"))
        first_lines = first_lines.join(header_cells, "path", "left")
        names = F.when(F.col("head").isNull(), names).otherwise(F.col("long_header"))
    first_lines = first_lines.select("path", "not_samples", _column_names(names).alias("names"))
    first_lines = first_lines.select("path", "not_samples", _unique_names("names").alias("header"))
    if long is not None:
        first_lines = written(first_lines, "headers")
    offsets = (
        lines.groupBy("path", "block")
        .agg(F.count_if(filled).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(first_lines, "path")
        .select("path", "block", run_of("path"), "header", (F.col("before") - F.col("not_samples") - 1).alias("shift"))
    )
    placed = (
        lines.withColumn("place", F.count_if(filled).over(in_split))
        .where(filled)
        .join(offsets, ["path", "block"])
        .withColumn("sample_idx", F.col("place") + F.col("shift"))
        .where(F.col("sample_idx") >= 0)
    )
    records = placed if long is None else placed.where("not long")
    records = records.select("run_id", "sample_idx", "header", F.col("value").alias("line"), *passed_on)
    samples = _samples(records, drop, cycles, strict, passed_on, reasons)
    if long is None:
        return samples
    rows = placed.where("long").select("path", "block", "seq", "run_id", "sample_idx", "header")
    return samples.unionByName(_long_samples(rows, long, drop, cycles, strict, passed_on, reasons))


def counter_steps_lines(lines: DataFrame, **options) -> DataFrame:
    """:func:`counter_scan_lines` with what came before each sample, as :func:`runscope.operators.series.steps` has it.

    The split of a line is how lines are distributed already, so looking for a predecessor within it moves no sample. The
    last known values of a split, one row per counter, are carried on to the splits behind.
    """
    known = F.when(F.col("value").isNotNull(), F.struct("value", F.col("sample_idx").alias("at")))
    split = ["path", "block", "counter"]
    before = Window.partitionBy(*split).orderBy("sample_idx").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("path", "counter").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    samples = counter_scan_lines(lines, passed_on=("path", "block"), **options)
    samples = written(samples.withColumn("known", F.last(known, ignorenulls=True).over(before)), "steps")
    last = samples.groupBy(*split).agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("sample_idx"))).alias("value"), F.max(F.when(F.col("value").isNotNull(), F.col("sample_idx"))).alias("at"))
    carried = last.select(*split, F.last(F.when(F.col("at").isNotNull(), F.struct("value", "at")), ignorenulls=True).over(earlier).alias("carried"))
    carried = carried.where(F.col("carried").isNotNull())
    found = join_per_key(samples, carried, split, "left", BROADCAST_BYTES).withColumn("known", F.coalesce("known", "carried"))
    return found.select("run_id", "sample_idx", "cycles", "counter", "value", F.col("known.value").alias("previous"), F.col("known.at").alias("previous_at"))


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Samples parsed with ``reasons`` → samples, rejects ``(run_id, sample_idx, counter, cell, reason)``, and counts.

    Files are parsed once, into the shared folder, and the counts are observed meanwhile: cells in all, and
    rejects by reason. ``sample_idx`` is the record's number from the first sample.
    """
    seen = Observation("counter cells")
    counts = [F.count_if(F.col("reason") == r).alias(r) for r in REASONS]
    table = written(parsed.observe(seen, F.count("*").alias("all"), *counts), "parsed-counters")
    rejects = table.where("reason is not null").select("run_id", "sample_idx", "counter", "cell", "reason")
    return table.drop("cell", "reason"), rejects, {k: v or 0 for k, v in seen.get.items()}


def _read_by_spark(spark: SparkSession, paths: str | Sequence[str], whole_file_bytes: int, name: str | None) -> tuple[DataFrame, DataFrame]:
    """Small files whole and the lines of large ones, through Spark's reader; the sizes prune its listing."""
    size, run = F.col("_metadata.file_size"), is_run("_metadata.file_path")
    small = text_of(spark, paths, name, wholetext=True).where((size <= whole_file_bytes) & run)
    large = text_of(spark, paths, name).where((size > whole_file_bytes) & run)
    return (
        small.select(F.col("_metadata.file_path").alias("path"), "value"),
        large.select(*line_columns(), F.monotonically_increasing_id().alias("seq")),
    )


def read_counter_samples(
    spark: SparkSession,
    paths: str | Sequence[str],
    whole_file_bytes: int = WHOLE_FILE_BYTES,
    name: str | None = None,
    with_steps: bool = False,
    **options,
) -> DataFrame:
    """Samples of all counter files below ``paths``; the run is the file's directory.

    File size decides the way each file is parsed, so no file is read by both. The executors list and
    read, where they can (see :func:`runscope.sources.texts.listed_texts`). The lines of large files are first written to the shared folder:
    where a file is split may depend on the cores there are when a scan starts, hence only one
    scan may tell. On ``name`` see :func:`runscope.sources.logs.text_of`. ``with_steps`` adds what came before each
    sample, so that deltas need no shuffle.
    """
    files = listed_texts(spark, paths, name)
    if files is None:
        small, large = _read_by_spark(spark, paths, whole_file_bytes, name)
        none_large = large.isEmpty()
    else:
        files = files.where(is_run("path"))
        large = files.where(F.col("length") > whole_file_bytes)
        none_large = large.isEmpty()
        small, large = whole_texts(files.where(F.col("length") <= whole_file_bytes)), text_lines(large)
    small = small.select(run_of("path"), "value")
    samples = steps(counter_lines(small, **options)) if with_steps else counter_scan(small, **options)
    if none_large:
        return samples
    table = fresh_path(spark, "counter-lines")
    large.write.parquet(table)
    scan = counter_steps_lines if with_steps else counter_scan_lines
    return samples.unionByName(scan(spark.read.parquet(table), **options))
