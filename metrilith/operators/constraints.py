"""Declared constraints over tables, broken ones as coded issues.

Constraints of a row, of a key and of an order are declared by name. What they look at is
worked out once; keys and orders then have exchanges of their own, of narrow rows, none of
which brings a whole group together.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrilith.operators.tables import Scratch

FAIL, WARNING, PASS = "FAIL", "WARNING", "PASS"
_ISSUE = "array<struct<severity:string,code:string,message:string>>"
#: Lines of a group whose order is looked at together.
SPAN = 1 << 20


@dataclass(frozen=True)
class Rule:
    """`broken` is true for a row with the issue."""

    code: str
    broken: Column
    message: str
    severity: str = FAIL


@dataclass(frozen=True)
class Unique:
    """Of rows of one group with equal `key`, all after the first break the rule; rows with a null key don't."""

    code: str
    key: Column
    message: str
    severity: str = FAIL


@dataclass(frozen=True)
class Increasing:
    """A row whose `value` isn't above that of the last row of its group that has one breaks the rule."""

    code: str
    value: Column
    message: str
    severity: str = FAIL


@dataclass(frozen=True)
class Constraints:
    """What holds within one file: rows stand in `line` order, keys and orders hold within `group`."""

    file: str
    line: str
    group: tuple[str, ...]
    rules: tuple[Rule | Unique | Increasing, ...] = field(default_factory=tuple)


def issues(rows: DataFrame, c: Constraints) -> DataFrame:
    """(file, line, severity, code, message): a row for each broken rule of each row of `rows`.

    The rules' keys and values are worked out once and written with what rows break by themselves.
    Equal keys meet by key; an order is looked at in stretches of SPAN lines, then between the ends of
    neighbouring stretches, so that a group may hold any number of rows. Lines are numbers.
    """
    by = [c.file, *c.group]
    issue = lambda r: F.struct(F.lit(r.severity).alias("severity"), F.lit(r.code).alias("code"), F.lit(r.message).alias("message"))
    single = [r for r in c.rules if isinstance(r, Rule)]
    several = {f"__rule_{i}": r for i, r in enumerate(c.rules) if not isinstance(r, Rule)}
    broken = F.array_compact(F.array(*(F.when(r.broken, issue(r)) for r in single))).cast(_ISSUE).alias("__issues")
    keyed = rows.select(*dict.fromkeys([*by, c.line]), broken, *((r.key if isinstance(r, Unique) else r.value).alias(n) for n, r in several.items()))
    if several:
        keyed = Scratch(rows.sparkSession, "constraints").write(keyed, "keyed")
    shape = lambda df, i: df.select(F.col(c.file).alias("file"), F.col(c.line).alias("line"), i)
    out = shape(keyed, F.inline("__issues"))
    for name, rule in several.items():
        held = keyed.select(*by, c.line, name).filter(F.col(name).isNotNull())
        if isinstance(rule, Unique):
            found = held.withColumn("__place", F.row_number().over(Window.partitionBy(*by, name).orderBy(c.line))).filter("__place > 1")
        else:
            held = held.withColumn("__part", F.floor(F.col(c.line) / SPAN))
            inside = held.withColumn("__before", F.lag(name).over(Window.partitionBy(*by, "__part").orderBy(c.line)))
            ends = held.groupBy(*by, "__part").agg(F.min(c.line).alias(c.line), F.min_by(name, c.line).alias(name), F.max_by(name, c.line).alias("__last"))
            between = ends.withColumn("__before", F.lag("__last").over(Window.partitionBy(*by).orderBy("__part")))
            found = inside.drop("__part").unionByName(between.drop("__part", "__last")).filter(F.col(name) <= F.col("__before"))
        out = out.unionByName(shape(found, F.inline(F.array(issue(rule)))))
    return out


def truth_rules(number=lambda c: F.col(c).try_cast("double")) -> Constraints:
    """What a truth file's rows have to hold: a point, finite places, whole frames from 0 that don't repeat, finite times that rise.

    Cells are text; blank frames and times are left out of their rules.
    """
    finite = lambda c: F.coalesce(F.abs(number(c)) < float("inf"), F.lit(False))
    given = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    frame, time = number("frame"), number("timestamp_s")
    whole = finite("frame") & (frame >= 0) & (frame == F.floor(frame))
    return Constraints(
        "file", "line", ("point",),
        (
            Rule("GT_POINT_ID", F.col("point") == "", "point_id is empty"),
            Rule("GT_XYZ", ~(finite("gt_x_mm") & finite("gt_y_mm") & finite("gt_z_mm")), "GT XYZ must be finite mm"),
            Rule("GT_FRAME", given("frame") & ~whole, "frame must be a non-negative integer"),
            Unique("GT_DUPLICATE_FRAME", F.when(whole, frame), "duplicate frame + point"),
            Rule("GT_TIMESTAMP", given("timestamp_s") & ~finite("timestamp_s"), "timestamp must be finite"),
            Unique("GT_DUPLICATE_TIMESTAMP", F.when(finite("timestamp_s"), time), "duplicate timestamp + point"),
            Increasing("GT_TIMESTAMP_ORDER", F.when(finite("timestamp_s"), time), "timestamp must be strictly increasing per point"),
        ),
    )


#: Columns that a truth file has to have, and the further one of each alignment.
TRUTH = ("point_id", "gt_x_mm", "gt_y_mm", "gt_z_mm")
ALIGNED = {"frame": "frame", "timestamp": "timestamp_s"}


def truth_issues(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(file, line, severity, code, message) over truth files; line is null for what concerns a whole file.

    `files` has (file, alignment) of every file that should be there; `rows` has (file, line, cells), cells
    by the file's own columns. A file without rows is GT_EMPTY; one that lacks columns is
    GT_FIELDS, and its rows aren't looked at; one without its alignment's column is GT_ALIGNMENT_FIELD.
    """
    # first lines are found by numbers alone: cells of other rows aren't built or sorted for it; what is broadcast has a row for each file
    first = rows.groupBy(F.col("file").alias("__file")).agg(F.min("line").alias("__first"))
    heads = rows.join(F.broadcast(first), (F.col("file") == F.col("__file")) & (F.col("line") == F.col("__first")), "left_semi")
    names = heads.groupBy("file").agg(F.first(F.map_keys("cells")).alias("names"))
    heads = files.join(names, "file", "left")
    lacks = F.filter(F.array(*map(F.lit, TRUTH)), lambda c: ~F.array_contains("names", c))
    aligned = F.try_element_at(F.create_map(*(F.lit(x) for pair in ALIGNED.items() for x in pair)), F.col("alignment"))
    of_file = lambda code, message: F.struct(F.lit(FAIL).alias("severity"), F.lit(code).alias("code"), message.alias("message"))
    whole = (
        F.when(F.col("names").isNull(), of_file("GT_EMPTY", F.lit("GT has no records")))
        .when(F.size(lacks) > 0, of_file("GT_FIELDS", F.concat(F.lit("missing GT fields "), F.array_join(F.array_sort(lacks), ", "))))
        .when(~F.array_contains("names", aligned), of_file("GT_ALIGNMENT_FIELD", F.concat(F.lit("missing "), aligned)))
    )
    of_files = heads.select("file", F.lit(None).cast("bigint").alias("line"), whole.alias("i")).filter("i is not null").select("file", "line", "i.*")
    complete = heads.filter(F.size(lacks) == 0).select("file")
    cell = lambda c: F.try_element_at("cells", F.lit(c))
    flat = rows.join(F.broadcast(complete), "file", "left_semi").select("file", F.col("line").cast("bigint").alias("line"), F.trim(F.coalesce(cell("point_id"), F.lit(""))).alias("point"), *(cell(c).alias(c) for c in (*TRUTH[1:], "frame", "timestamp_s")))
    return of_files.unionByName(issues(flat, truth_rules()))


def verdicts(found: DataFrame, files: DataFrame, file: str = "file") -> DataFrame:
    """(file, status, fails, warnings) of every file of `files`: FAIL over WARNING over PASS."""
    counts = found.groupBy(file).agg(F.count_if(F.col("severity") == FAIL).alias("fails"), F.count_if(F.col("severity") == WARNING).alias("warnings"))
    out = files.select(file).join(counts, file, "left").na.fill(0)
    return out.select(file, F.when(F.col("fails") > 0, FAIL).when(F.col("warnings") > 0, WARNING).otherwise(PASS).alias("status"), "fails", "warnings")
