"""Program facts: the intermediate representation as tables, its scans, predicates and seeds.

A front end outside this library writes these tables; every name is globally unique.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pushgraph.functions.semiring import MIN_PLUS
from pushgraph.operators.closure import reachable
from pushgraph.plans.fixpoint import fixpoint

SCHEMAS = {
    "stmt": "stmt string, method string, ord long, kind string",
    "cfg_edge": "src string, dst string",
    "assign": "stmt string, lhs string, rhs string",
    "load": "stmt string, lhs string, base string, field string",
    "store": "stmt string, base string, field string, rhs string",
    "static_load": "stmt string, lhs string, field string",
    "static_store": "stmt string, field string, rhs string",
    "alloc": "stmt string, val string, type string, kind string, const string",
    "call": "stmt string, recv string, sig string, kind string, lhs string",
    "call_edge": "site string, caller string, callee string, kind string",
    "arg": "stmt string, pos int, val string",
    "param": "method string, pos int, val string",
    "ret": "stmt string, val string",
    "method": "method string, cls string, static boolean, has_body boolean, native boolean, phantom boolean, clinit boolean, app boolean",
    "subtype": "sub string, sup string",
    "vtable": "type string, sig string, method string",
    "null_branch": "src string, dst string, val string",
    "instance_of": "stmt string, lhs string, val string",
    "flag_branch": "src string, dst string, val string",
    "local": "val string, method string, type string",
    "cast": "stmt string, rhs string, type string",
    "class_info": "type string, phantom boolean, interface boolean",
    "lib_model": "name string, src int, dst int",
    "static_field": "field string, cls string",
    "entry": "method string",
    "hidden": "type string, sig string",
}
#: Position of the result among a library model's positions.
RESULT = -2
#: Position of the receiver among arguments and parameters.
THIS = -1
ARRAY = "array"
# String types that are no allocations unless strings are tracked.
STRING_TYPES = ("java.lang.String", "java.lang.StringBuilder", "java.lang.StringBuffer")


@dataclass
class Program:
    """The fact tables of a program; absent ones are empty. Array accesses are loads and stores of field ``array``.

    null_branch: edges that a value which is null does not take; flag_branch: those taken where val, the result of an
    instance_of, is true. local: what method a value belongs to and its declared type (null: no class). cast: assignments that cast.
    lib_model: for calls without a body, by name, what argument (-1: receiver) flows to what argument or result (-2). hidden:
    methods that are not public or are static. entry: methods that a run starts with.
    """

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    blank: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        if name in self.tables:
            return self.tables[name]
        if name not in self.blank:
            self.blank[name] = self.spark.createDataFrame([], SCHEMAS[name])
        return self.blank[name]

    @classmethod
    def read(cls, spark: SparkSession, path: str, names: Iterable[str] = SCHEMAS) -> Program:
        """Facts stored as one Parquet table each under path."""
        return cls(spark, {n: spark.read.schema(SCHEMAS[n]).parquet(f"{path}/{n}.parquet") for n in names})

    @classmethod
    def of(cls, spark: SparkSession, **rows: list[tuple]) -> Program:
        return cls(spark, {n: spark.createDataFrame(r, SCHEMAS[n]) for n, r in rows.items()})


def straight_line_edges(stmts: DataFrame) -> DataFrame:
    """cfg_edge rows that lead from each statement to the next of its method, by ord."""
    w = Window.partitionBy("method").orderBy("ord", "stmt")
    return stmts.select(F.col("stmt").alias("src"), F.lead("stmt").over(w).alias("dst")).filter(F.col("dst").isNotNull())


def successors(p: Program) -> DataFrame:
    return p.cfg_edge.select("src", "dst").distinct()


def predecessors(p: Program) -> DataFrame:
    """The reverse graph: the same edges, turned."""
    return p.cfg_edge.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()


def start_points(p: Program) -> DataFrame:
    """(stmt, method): statements without predecessor."""
    return p.stmt.join(p.cfg_edge.select(F.col("dst").alias("stmt")).distinct(), "stmt", "left_anti").select("stmt", "method")


def end_points(p: Program) -> DataFrame:
    """(stmt, method): statements without successor."""
    return p.stmt.join(p.cfg_edge.select(F.col("src").alias("stmt")).distinct(), "stmt", "left_anti").select("stmt", "method")


def call_sites(p: Program) -> DataFrame:
    """(method, sites): the call statements of each method, in order."""
    return p.stmt.join(p.call.select("stmt").distinct(), "stmt", "left_semi").groupBy("method").agg(F.array_sort(F.collect_set("stmt")).alias("sites"))


def plain_start_points(p: Program) -> DataFrame:
    """Statements that neither start a method nor call."""
    return p.stmt.join(start_points(p).select("stmt"), "stmt", "left_anti").join(p.call.select("stmt"), "stmt", "left_anti").select("stmt", "method")


def plain_end_points(p: Program) -> DataFrame:
    """Statements that neither end a method nor call."""
    return p.stmt.join(end_points(p).select("stmt"), "stmt", "left_anti").join(p.call.select("stmt"), "stmt", "left_anti").select("stmt", "method")


def reachable_methods(p: Program, entries: DataFrame) -> DataFrame:
    """(method): methods that call edges reach from entries (method)."""
    edges = p.call_edge.select(F.lit(0).cast("bigint").alias("qid"), F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return reachable(edges, entries.select(F.lit(0).cast("bigint").alias("qid"), F.col("method").alias("node"))).select(F.col("node").alias("method"))


def reachable_statements(p: Program, entries: DataFrame) -> DataFrame:
    return p.stmt.join(reachable_methods(p, entries), "method", "left_semi").select("stmt", "method")


def has(p: Program, name: str) -> bool:
    """Whether the program comes with the table."""
    return name in p.tables


def is_allocation(*, strings: bool = False, nulls: bool = False, arrays: bool = True, throwables: bool = False, constants: bool = False, throwable: Column | None = None) -> Column:
    """Predicate on alloc rows, in the order of the options: first match decides.

    kind: new, new_array, multi_array, null, string, int, length, big_integer. constants is the profile of integer
    and string constants. throwable: whether the row's type is a subtype of Throwable; without it, types are told by name.
    """
    k, t = F.col("kind"), F.col("type")
    if constants:
        return k.isin("int", "string", "new", "new_array", "multi_array", "length", "big_integer")
    out = F.when(F.lit(not strings) & (k == "new") & t.isin(*STRING_TYPES), False).when(k == "null", F.lit(nulls)).when(k.isin("new_array", "multi_array"), F.lit(arrays)).when(k == "string", F.lit(strings))
    if not throwables:
        out = out.when(t.rlike(r"(^|\.)[A-Za-z]*(Throwable|Exception|Error)$") if throwable is None else throwable, False)
    return out.otherwise(k == "new")


def allocations(p: Program, **options) -> DataFrame:
    """alloc rows that are allocations by the options; with subtype rows, exceptions are told by them, not by name."""
    rows = p.alloc
    if has(p, "subtype") and not options.get("throwables"):
        below = subtype_closure(p).filter(F.col("sup").rlike(r"(^|\.)Throwable$")).select(F.col("sub").alias("type"), F.lit(True).alias("_throwable")).distinct()
        rows = rows.join(below, "type", "left").withColumn("_throwable", F.coalesce("_throwable", F.lit(False)))
        return rows.filter(is_allocation(throwable=F.col("_throwable"), **options)).select(*p.alloc.columns)
    return rows.filter(is_allocation(**options))


def allocation_at(p: Program, asked: DataFrame, **options) -> DataFrame:
    """asked (stmt, val) -> (stmt, val, alloc_stmt, alloc_val, type): the allocation that the statement assigns to val: its own, or
    else what a callee's return statement allocates (the least such statement)."""
    rows = allocations(p, **options).select(F.col("stmt").alias("alloc_stmt"), F.col("val").alias("alloc_val"), "type")
    own = asked.join(rows, (F.col("stmt") == F.col("alloc_stmt")) & (F.col("val") == F.col("alloc_val"))).select("stmt", "val", "alloc_stmt", "alloc_val", "type")
    results = asked.join(p.call.select("stmt", F.col("lhs").alias("val")), ["stmt", "val"]).join(p.call_edge.select(F.col("site").alias("stmt"), "callee"), "stmt")
    ends = end_points(p).select(F.col("stmt").alias("alloc_stmt"), F.col("method").alias("callee")).join(p.ret.select(F.col("stmt").alias("alloc_stmt"), F.col("val").alias("alloc_val")), "alloc_stmt")
    made = results.join(ends, "callee").join(rows, ["alloc_stmt", "alloc_val"]).join(own.select("stmt", "val"), ["stmt", "val"], "left_anti")
    first = made.groupBy("stmt", "val").agg(F.min(F.struct("alloc_stmt", "alloc_val", "type")).alias("a"))
    return own.unionByName(first.select("stmt", "val", "a.*")).distinct()


def ignored_methods(p: Program, *, throwables: bool = False) -> DataFrame:
    """(method): methods of exception classes, where exceptions are tracked; none otherwise."""
    if not throwables:
        return p.method.select("method").limit(0)
    below = subtype_closure(p).filter(F.col("sup").rlike(r"(^|\.)Throwable$")).select(F.col("sub").alias("cls")).distinct()
    return p.method.join(below, "cls", "left_semi").select("method")


def instance_branches(p: Program) -> DataFrame:
    """null_branch rows that instance_of gives: null is an instance of nothing, so it takes no edge on which the test is true."""
    return p.flag_branch.withColumnRenamed("val", "lhs").join(p.instance_of.select("lhs", "val"), "lhs").select("src", "dst", "val").distinct()


def entry_points(p: Program) -> DataFrame:
    """(stmt, method): first statements of the methods that a run starts with."""
    return start_points(p).join(p.entry, "method", "left_semi").select("stmt", "method")


def initialiser_ends(p: Program) -> DataFrame:
    """(stmt, cls): last statements of the static initialisers."""
    return end_points(p).join(p.method.filter("clinit").select("method", "cls"), "method").select("stmt", "cls")


def method_scope(p: Program, queries: DataFrame) -> DataFrame:
    """(query, method): the method of each query (query, stmt), and all that call it, directly or not."""
    first = queries.select("query", "stmt").join(p.stmt.select("stmt", "method"), "stmt").select("query", "method")
    up = p.call_edge.select(F.col("callee").alias("src"), F.col("caller").alias("dst")).distinct()
    step = lambda total, delta: delta.join(up, F.col("method") == F.col("src")).select("query", F.col("dst").alias("method"))
    return fixpoint(first, step, keys=["query", "method"]).whole()


def reflection_log(spark: SparkSession, path: str) -> DataFrame:
    """(kind, target, caller, line, guard): a ;-separated log of calls by reflection, one a line; absent columns are null."""
    return spark.read.option("sep", ";").schema("kind string, target string, caller string, line string, guard string").csv(path)


def class_list(spark: SparkSession, path: str) -> DataFrame:
    """(cls): a text of class names, one a line; empty lines are none."""
    return spark.read.text(path).select(F.trim("value").alias("cls")).filter("cls <> ''").distinct()


def properties(spark: SparkSession, path: str) -> DataFrame:
    """(key, value): a text of key=value lines; # and ! begin comments."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> '' and not line rlike '^[#!]'")
    return lines.select(F.trim(F.regexp_extract("line", r"^([^=:]*)[=:]?", 1)).alias("key"), F.trim(F.regexp_extract("line", r"^[^=:]*[=:](.*)$", 1)).alias("value"))


def whole_program_seeds(p: Program, entries: DataFrame, **options) -> DataFrame:
    """(stmt, val, type): every allocation in a reachable method."""
    return allocations(p, **options).join(reachable_statements(p, entries).select("stmt"), "stmt", "left_semi").select("stmt", "val", "type").distinct()


def application_seeds(p: Program, entries: DataFrame, *, initialisers: bool = False, **options) -> DataFrame:
    """The same where calls are followed into application classes with bodies only.

    initialisers: the static initialisers of the entries' classes are entered too.
    """
    if initialisers:
        classes = p.method.join(entries.select("method"), "method", "left_semi").select("cls").distinct()
        entries = entries.select("method").unionByName(p.method.filter("clinit").join(classes, "cls", "left_semi").select("method")).distinct()
    inside = p.method.filter(F.col("app") & F.col("has_body")).select(F.col("method").alias("callee"))
    some = Program(p.spark, p.tables | {"call_edge": p.call_edge.join(inside, "callee", "left_semi").select("site", "caller", "callee", "kind")})
    return whole_program_seeds(some, entries, **options)


def used_values(p: Program) -> DataFrame:
    """(stmt, val): values that a statement assigns, returns, passes or calls on."""
    parts = [p.assign.select("stmt", F.explode(F.array("lhs", "rhs")).alias("val")), p.load.select("stmt", F.explode(F.array("lhs", "base")).alias("val")), p.store.select("stmt", F.explode(F.array("base", "rhs")).alias("val")), p.ret.select("stmt", "val"), p.arg.select("stmt", "val"), p.call.select("stmt", F.explode(F.array("recv", "lhs")).alias("val")), p.alloc.select("stmt", "val")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.filter(F.col("val").isNotNull()).distinct()


def killed_values(p: Program) -> DataFrame:
    """(stmt, val): values that a statement overwrites; x = x.f keeps x."""
    loads = p.load.filter(F.col("lhs") != F.col("base")).select("stmt", F.col("lhs").alias("val"))
    parts = [p.assign.select("stmt", F.col("lhs").alias("val")), loads, p.static_load.select("stmt", F.col("lhs").alias("val")), p.alloc.select("stmt", "val"), p.call.filter(F.col("lhs").isNotNull()).select("stmt", F.col("lhs").alias("val")), p.static_store.select("stmt", F.concat(F.lit("static:"), "field").alias("val"))]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.distinct()


def subtype_closure(p: Program) -> DataFrame:
    """(sub, sup): reflexive and transitive."""
    from pushgraph.operators.closure import transitive_closure

    edges = p.subtype.select(F.lit(0).cast("bigint").alias("qid"), F.col("sub").alias("src"), F.col("sup").alias("dst"))
    own = p.subtype.select(F.explode(F.array("sub", "sup")).alias("sub")).distinct().withColumn("sup", F.col("sub"))
    return transitive_closure(edges).select(F.col("src").alias("sub"), F.col("dst").alias("sup")).unionByName(own).distinct()


def dispatch(p: Program, receivers: DataFrame) -> DataFrame:
    """(site, type, method): the method that each call on a receiver type runs: the nearest up the superclass chain.

    receivers: (site, type, sig). An array type runs its element type's. Where a supertype is Thread, start runs run too.
    """
    want = receivers.select("site", F.regexp_replace("type", r"(\[\])+$", "").alias("type"), "sig").distinct()
    up = p.subtype.select(F.lit(0).cast("bigint").alias("qid"), F.col("sub").alias("src"), F.col("sup").alias("dst"))
    start = want.select("type").distinct().select("type", F.col("type").alias("at"), F.lit(0).alias("depth"))

    step = lambda total, delta: delta.join(up, F.col("at") == F.col("src")).select("type", F.col("dst").alias("at"), (F.col("depth") + 1).alias("depth"))
    above = fixpoint(start, step, keys=["type", "at"], weight="depth", semiring=MIN_PLUS).whole()
    threads = above.filter(F.col("at").rlike(r"(^|\.)Thread$")).select("type").distinct()
    want = want.unionByName(want.filter("sig = 'start()'").join(threads, "type", "left_semi").select("site", "type", F.lit("run()").alias("sig"))).distinct()
    found = want.join(above, "type").join(p.vtable.select(F.col("type").alias("at"), "sig", "method"), ["at", "sig"])
    return found.groupBy("site", "type", "sig").agg(F.min_by("method", F.struct("depth", "at", "method")).alias("method")).select("site", "type", "method").distinct()


def named_constants(rows: DataFrame) -> DataFrame:
    """Statement rows (stmt, method, ord, lhs, const) with each constant moved into a fresh local before its use.

    The original keeps its place with the local instead of the constant; ord is renumbered in method order.
    """
    fresh = F.concat(F.lit("const$"), "stmt")
    split = F.when(F.col("const").isNotNull(), F.array(F.struct(F.concat("stmt", F.lit("$c")).alias("stmt"), F.lit(0).alias("sub"), fresh.alias("lhs"), F.col("const").alias("rhs")), F.struct(F.col("stmt"), F.lit(1).alias("sub"), F.col("lhs"), fresh.alias("rhs"))))
    whole = F.array(F.struct(F.col("stmt"), F.lit(0).alias("sub"), F.col("lhs"), F.lit(None).cast("string").alias("rhs")))
    out = rows.select("method", "ord", F.explode(F.coalesce(split, whole)).alias("s")).select("method", "ord", "s.*")
    return out.select("stmt", "method", (F.row_number().over(Window.partitionBy("method").orderBy("ord", "sub", "stmt")) - 1).cast("bigint").alias("ord"), "lhs", "rhs")


def may_have_more_edges(p: Program, possible: DataFrame) -> DataFrame:
    """(site): sites for which possible (site, callee) edges are not all known."""
    return possible.select("site", "callee").join(p.call_edge.select("site", "callee"), ["site", "callee"], "left_anti").select("site").distinct()
