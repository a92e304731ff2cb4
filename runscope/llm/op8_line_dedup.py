"""Line dedup by a log-template tree.

A line's tokens (split at white space) are masked where they hold a digit. The tree has a fixed
depth: a leaf is the token count and the first ``DEPTH`` tokens. In a leaf, the token that most
different lines have at a place stands in the leaf's template if at least half of them have it; else the place is a
variable field. Copies of a line count once there, so that one that is copied often hides no family of others. A line
follows its leaf's template if it agrees with it in at least ``SIMILAR`` percent of the tokens.

The lines of a leaf that don't follow get a template among themselves, again until none follows. Then they
are parted at the place with the token that most of them, but not all, have, among
tokens that could recur: each such token gets a branch, and all other tokens of the place share one. A branch is treated as
a leaf, until its lines follow, can't be parted or are too few to recur. So a leaf may hold any number of
families. A line that follows nothing is its own template.

A template on lines of ``MIN_DOCS`` or more documents recurs: all its lines are dropped but the first, that of the
smallest document, so that what it says is not lost. A line of ``LONG_WORDS`` tokens or more can't be
shared by chance: its own masked tokens recur from ``LONG_DOCS`` documents on.

Lines are told apart by the 64-bit hash of their masked tokens. Lines end at a newline; blank lines
are never dropped. Null texts stay null, empty ones empty. Documents without an id count as one
document, the largest. Repeated rows of one id are one document, and lose the same lines. All of it
is built-in functions; a template that a third of all lines follow is counted per task first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from runscope.llm.tables import measured, written

DEPTH, SIMILAR, MIN_DOCS = 3, 70, 20
LONG_WORDS, LONG_DOCS = 10, 2
VARIABLE = "<*>"
_BLANK = " \t\x0b\x0c\r"


def _tokens(line: Column) -> Column:
    """Tokens of a line, those with a digit masked; one empty token for a blank line."""
    tokens = F.split(F.trim(line, F.lit(_BLANK)), r"[ \t\x0B\f\r]+")
    masked = F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit(VARIABLE)).otherwise(t))
    return F.when(line.rlike("[0-9]"), masked).otherwise(tokens)


def _lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, line_no, tokens, line, leaf)`` of each line that isn't blank."""
    lines = docs.where("text is not null").select(
        "doc_id", _row_key().alias("row"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw")
    )
    # a test of the line itself: one of its tokens would split every line once more
    lines = lines.where(F.col("raw").rlike(r"[^ \t\x0B\f\r]"))
    tokens = lines.select("doc_id", "row", "line_no", _tokens(F.col("raw")).alias("tokens"))
    return tokens.withColumns(
        {
            "line": F.xxhash64("tokens"),
            "size": F.size("tokens"),
            "leaf": F.xxhash64(F.size("tokens"), F.slice("tokens", 1, DEPTH)),
        }
    )


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _distinct_docs(lines: DataFrame, key: str) -> DataFrame:
    """How many documents have each key; distinct pairs first, so that no key is gathered."""
    return lines.select(key, "doc_id").distinct().groupBy(key).agg(F.count("*").alias("docs"))


def _groups(lines: DataFrame, min_docs: int) -> DataFrame:
    """``(group, kinds)``: groups of several different lines, on enough lines for a template of their own."""
    groups = lines.groupBy("group").agg(F.count("*").alias("kinds"), F.sum("weight").alias("total"))
    return groups.where((F.col("kinds") > 1) & (F.col("total") >= min_docs)).select("group", "kinds")


def _places(lines: DataFrame) -> DataFrame:
    return lines.select("group", "line", "weight", F.posexplode("tokens").alias("place", "token"))


def _following(lines: DataFrame, groups: DataFrame) -> DataFrame:
    """``(line, template)``: lines that follow the one template that their group's majorities make."""
    places = _places(lines)
    counted = places.groupBy("group", "place", "token").agg(F.count("*").alias("n"))
    top = counted.groupBy("group", "place").agg(F.max(F.struct("n", "token")).alias("top"))
    constant = (
        top.join(groups, "group")
        .where((F.col("top.n") * 2 >= F.col("kinds")) & (F.col("top.token") != VARIABLE))
        .select("group", "place", F.col("top.token").alias("token"))
    )
    agreeing = places.join(constant, ["group", "place", "token"]).groupBy("group", "line").agg(F.count("*").alias("same"))
    sizes = lines.select("group", "line", F.size("tokens").alias("size"), F.size(F.filter("tokens", lambda t: t == VARIABLE)).alias("masked"))
    return (
        sizes.join(agreeing, ["group", "line"])
        .where((F.col("same") + F.col("masked")) * 100 >= F.col("size") * SIMILAR)
        .select("line", F.col("group").alias("template"))
    )


def _parted(lines: DataFrame, min_docs: int) -> DataFrame:
    """Lines of groups that have no template, in smaller groups; without those that can't be parted.

    Every branch is smaller than its group, as the token that it is parted by is not that of all.
    """
    groups = _groups(lines, min_docs)
    lines = lines.join(groups.select("group"), "group", "left_semi")
    counted = _places(lines).groupBy("group", "place", "token").agg(F.count("*").alias("n"), F.sum("weight").alias("total"))
    common = counted.where((F.col("total") >= min_docs) & (F.col("token") != VARIABLE)).join(groups, "group")
    common = written(common.where("n < kinds").select("group", "place", "token", "n"), "leaf-tokens")
    at = common.groupBy("group").agg(F.max(F.struct("n", (-F.col("place")).alias("back"))).alias("best"))
    at = at.select("group", (-F.col("best.back")).alias("place"))
    branches = common.join(at, ["group", "place"]).select("group", "token", F.lit(True).alias("common"))
    branch = F.when(F.col("common"), F.col("token"))  # null: any other token
    return (
        lines.join(at, "group")
        .withColumn("token", F.get("tokens", F.col("place")))
        .join(branches, ["group", "token"], "left")
        .select("line", "tokens", "weight", F.xxhash64("group", "place", branch, branch.isNull()).alias("group"))
    )


def leaf_templates(lines: DataFrame, tokens_of: DataFrame, min_docs: int) -> DataFrame:
    """``(line, template)``: lines that follow a template of their leaf, where it could recur.

    ``lines(doc_id, line, leaf)`` of all lines; ``tokens_of(line, leaf, tokens)`` of the same ones.
    """
    weight = lines.groupBy("leaf", "line").agg(F.count("*").alias("weight"))
    leaves = measured(_groups(weight.withColumnRenamed("leaf", "group"), min_docs), "leaves")
    rest = tokens_of.join(leaves.select(F.col("group").alias("leaf")), "leaf", "left_semi").groupBy("line", F.col("leaf").alias("group"))
    rest = written(rest.agg(F.first("tokens").alias("tokens"), F.count("*").alias("weight")), "leaf-lines")
    found, groups = None, leaves
    while True:
        following = written(_following(rest, groups), "following")
        found = following if found is None else found.unionByName(following)
        rest = written(rest.join(following.select("line"), "line", "left_anti"), "leaf-rest")
        followed = following.select(F.col("template").alias("group")).distinct()
        again = rest.join(followed, "group", "left_semi").withColumn("group", F.xxhash64("group", F.lit("rest")))
        rest = written(again.unionByName(_parted(rest.join(followed, "group", "left_anti"), min_docs)), "leaf-lines")
        groups = _groups(rest, min_docs)
        if groups.isEmpty():
            return found
        rest = rest.join(groups.select("group"), "group", "left_semi")


def _later(own: DataFrame, min_docs: int) -> DataFrame:
    """``(row, line_no)`` of all lines of templates that recur, but the first of each."""
    recurring = measured(_distinct_docs(own, "template").where(F.col("docs") >= min_docs).select("template"), "recurring")
    found = own.join(recurring, "template")
    first = found.groupBy("template").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "line_no")).alias("first")
    )
    first = first.select("template", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"))
    later = found.join(measured(first, "first-lines"), "template").where(
        ~(F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("line_no") == F.col("first_line")))
    )
    return later.select("row", "line_no")


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, long_words: int | None = LONG_WORDS) -> DataFrame:
    """``(row, dropped array<int>)``: numbers of the lines to drop, by the hash of id and text."""
    every = _lines(docs)
    lines = written(every.drop("tokens"), "lines")
    following = leaf_templates(lines, every.select("line", "leaf", "tokens"), min_docs)
    following = measured(following, "following")
    own = lines.join(following, "line", "left").withColumn("template", F.coalesce("template", "line")).drop("leaf", "line", "size")
    later = _later(own, min_docs)
    if long_words is not None:
        long = lines.where(F.col("size") >= long_words).withColumnRenamed("line", "template").drop("leaf", "size")
        later = later.unionByName(_later(long, min(min_docs, LONG_DOCS)))
    return later.select("row", "line_no").distinct().groupBy("row").agg(F.collect_list("line_no").alias("dropped"))


_ROW, _DROPPED = "__line_dedup_row", "__line_dedup_dropped"


def _with_dropped(docs: DataFrame, min_docs: int, long_words: int | None) -> DataFrame:
    dropped = dropped_lines(docs, min_docs, long_words).select(F.col("row").alias(_ROW), F.col("dropped").alias(_DROPPED))
    return docs.withColumn(_ROW, _row_key()).join(dropped, _ROW, "left")


def _kept_text() -> Column:
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda line, i: ~F.array_contains(F.col(_DROPPED), i))
    return F.when(F.col(_DROPPED).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, long_words: int | None = LONG_WORDS) -> DataFrame:
    """All rows and columns of ``docs``, ``text`` without its recurring lines."""
    columns = [_kept_text().alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return _with_dropped(docs, min_docs, long_words).select(*columns)


def line_report(docs: DataFrame, min_docs: int = MIN_DOCS, long_words: int | None = LONG_WORDS) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, text)``, a row per row; ``text`` is what is kept."""
    return _with_dropped(docs.select("doc_id", "text"), min_docs, long_words).select(
        "doc_id",
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(_DROPPED), F.lit(0)).cast("long").alias("n_dropped"),
        _kept_text().alias("text"),
    )
