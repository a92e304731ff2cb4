"""Operators on configurations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from runscope.formats import RUN_RULES, Rule
from runscope.functions.labels import is_interactive
from runscope.joins import join_per_key


def config_overlay(
    base: DataFrame, override: DataFrame, fields: Sequence[str] | None = None, key: str = "run_id"
) -> DataFrame:
    """Values of ``override`` replace those of ``base`` where they are not NULL.

    Only fields the base knows take part; ``ignored`` lists the other non-NULL ones. ``false``
    and 0 are values and do override. ``override`` has at most one row per key.
    """
    known = [c for c in (fields or base.columns) if c != key]
    unknown = [c for c in override.columns if c != key and c not in known]
    o = override.select(F.col(key), *[F.col(c).alias(f"override_{c}") for c in override.columns if c != key])

    def overlaid(column: str) -> Column:
        if column not in known or column not in override.columns:
            return F.col(column)
        kept = base.schema[column].dataType
        return F.coalesce(F.col(f"override_{column}").cast(kept), F.col(column)).alias(column)

    if unknown:
        ignored = F.array_compact(
            F.array(*[F.when(F.col(f"override_{c}").isNotNull(), F.lit(c)) for c in unknown])
        )
    else:
        ignored = F.array().cast("array<string>")
    joined = base.join(o, key, "left")
    return joined.select(*[overlaid(c) for c in base.columns], ignored.alias("ignored"))


def _holds(rule: Rule) -> Column:
    """Whether a manifest row is the rule's member and satisfies it."""
    wanted = [F.col("member") == rule.member]
    if rule.kind is not None:
        wanted.append(F.col("kind") == rule.kind)
    for access in ("readable", "writable", "executable"):
        if getattr(rule, access):
            wanted.append(F.col(access))
    if rule.suffix is not None:
        base = F.substring_index("file_name", "/", -1)
        # a name that is nothing but the suffix is a hidden file without one
        wanted.append(base.endswith(rule.suffix) & (base != rule.suffix))
    held = wanted[0]
    for condition in wanted[1:]:
        held = held & condition
    return F.coalesce(held, F.lit(False))


def config_complete(
    manifest: DataFrame, rules: Sequence[Rule] = RUN_RULES, configs: DataFrame | None = None
) -> DataFrame:
    """verdict per config and the members that failed, in rule order.

    ``configs(config_id)`` adds those without any row in the manifest: all their members fail. The rules become aggregates of a single pass over ``manifest(config_id, member, …)``:
    pre-aggregated before the shuffle, with no join.
    """
    met = [F.bool_or(_holds(rule)).alias(f"met_{i}") for i, rule in enumerate(rules)]
    failed = F.array_compact(
        F.array(*[F.when(~F.col(f"met_{i}"), F.lit(rule.member)) for i, rule in enumerate(rules)])
    )
    if configs is not None:  # a row of NULLs meets no rule
        manifest = manifest.unionByName(configs.select("config_id"), allowMissingColumns=True)
    return (
        manifest.groupBy("config_id")
        .agg(*met)
        .select("config_id", (F.size(failed) == 0).alias("complete"), failed.alias("failed"))
    )


def batch_eligible(runs: DataFrame, complete: DataFrame, cmd: str = "cmd") -> DataFrame:
    """runs with a command whose configuration is complete."""
    passing = complete.where("complete").select("config_id")
    return join_per_key(runs.where(~is_interactive(F.col(cmd))), passing, "config_id", "left_semi")
