"""Typestate: machines as a table, and two phases over a program.

Phase 1 finds what every receiver may point to. It is complete before phase 2 starts, which is what makes the
kill of a strong update sound. Phase 2 carries states along the control flow, returns matched to their calls: a call on a receiver that
can only be the one allocation in its call context replaces the state, one on a receiver that may be another keeps the old one too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pushgraph.operators.alias import Solution, solve
from pushgraph.operators.flows import Options
from pushgraph.operators.pds import EPS
from pushgraph.operators.sync import CALL_END, Budget
from pushgraph.plans.fixpoint import fixpoint
from pushgraph.session import shuffled, written, written_counted
from pushgraph.sources.ir import THIS, Program, end_points, start_points, subtype_closure

# Machine; class; seed; initial state; error states; when calls act; transitions (from, methods, to).
# Seeds: "new" an allocation of the class or a subtype; "call m" the receiver of m; "result m" what m returns.
# Methods are names, as patterns; "sig:" a pattern over the whole signature; "public:" the instance methods that are public, by
# name; "native:" native ones. "@" gives a transition a time of its own.
MACHINES = """
FileMustBeClosed | File | new | INIT | OPENED | call | INIT sig:.*open.* OPENED; INIT sig:.*close.* CLOSED; OPENED sig:.*close.* CLOSED
FileMustBeClosedCallToReturn | File | new | INIT | OPENED | call_to_return | INIT sig:.*open.* OPENED; INIT sig:.*close.* CLOSED; OPENED sig:.*close.* CLOSED
HasNext | Iterator | result iterator | INIT | ERROR | return | INIT next ERROR; ERROR next ERROR; HASNEXT next INIT; INIT hasNext HASNEXT; HASNEXT hasNext HASNEXT; ERROR hasNext ERROR
Vector | Vector | new | INIT | ACCESSED_EMPTY | return | INIT add|addAll|addElement|insertElementAt|set|setElementAt NOT_EMPTY; INIT sig:<init>[(](java[.]util[.])?Collection[)] NOT_EMPTY; INIT elementAt|firstElement|lastElement|get ACCESSED_EMPTY; NOT_EMPTY elementAt|firstElement|lastElement|get NOT_EMPTY; ACCESSED_EMPTY elementAt|firstElement|lastElement|get ACCESSED_EMPTY; NOT_EMPTY removeAllElements INIT; INIT removeAllElements INIT
KeyStore | KeyStore | result getInstance | INIT | ERROR | call_to_return | INIT load LOADED; LOADED public:(?!load$).* LOADED; INIT public:(?!load$).* ERROR; ERROR public:(?!load$).* ERROR
Signature | Signature | result getInstance | UNITIALIZED | ERROR | return | NONE getInstance UNITIALIZED; UNITIALIZED initSign SIGN_CHECK; UNITIALIZED initVerify VERIFY_CHECK; UNITIALIZED sign|verify|update ERROR; SIGN_CHECK initSign SIGN_CHECK; SIGN_CHECK initVerify VERIFY_CHECK; SIGN_CHECK sign|update SIGN_CHECK; SIGN_CHECK verify ERROR; VERIFY_CHECK initSign SIGN_CHECK; VERIFY_CHECK initVerify VERIFY_CHECK; VERIFY_CHECK verify|update VERIFY_CHECK; VERIFY_CHECK sign ERROR; ERROR initSign|initVerify|sign|verify|update ERROR
Socket | Socket | new | INIT | ERROR | return | INIT connect CONNECTED; CONNECTED connect CONNECTED; ERROR connect ERROR; CONNECTED public:(?!connect$|is|<init>).* CONNECTED; INIT public:(?!connect$|is|<init>).* ERROR; ERROR public:(?!connect$|is|<init>).* ERROR
URLConn | URLConnection | call connect | CONNECTED | ERROR | return | CONNECTED setDoInput|setDoOutput|setAllowUserInteraction|setUseCaches|setIfModifiedSince|setRequestProperty|addRequestProperty|getRequestProperty|getRequestProperties ERROR; ERROR setDoInput|setDoOutput|setAllowUserInteraction|setUseCaches|setIfModifiedSince|setRequestProperty|addRequestProperty|getRequestProperty|getRequestProperties ERROR
InputStream | InputStream | call close | NONE | ERROR | return | NONE close CLOSED; CLOSED close CLOSED; CLOSED read ERROR; ERROR read ERROR; CLOSED sig:read[(][)] ERROR @call_to_return; ERROR sig:read[(][)] ERROR @call_to_return
OutputStream | OutputStream | call close | NONE | ERROR | return | NONE close CLOSED; CLOSED close CLOSED; CLOSED write ERROR; ERROR write ERROR
PipedInputStream | PipedInputStream | new | INIT | ERROR | return | INIT connect CONNECTED; INIT read ERROR; CONNECTED read CONNECTED; ERROR read ERROR
PipedOutputStream | PipedOutputStream | new | INIT | ERROR | return | INIT connect CONNECTED; INIT write ERROR; CONNECTED write CONNECTED; ERROR write ERROR
PrintStream | PrintStream | call close | CLOSED | ERROR | return | CLOSED close CLOSED; CLOSED public:(?!close$).* ERROR
PrintWriter | PrintWriter | call close | CLOSED | ERROR | return | NONE close CLOSED; CLOSED close CLOSED; CLOSED public:(?!close$).* ERROR; ERROR public:(?!close$).* ERROR
AllocInputStream | InputStream | call close | CLOSED | ERROR | return | OPEN close CLOSED; CLOSED close CLOSED; ERROR close ERROR; OPEN read OPEN; CLOSED read ERROR; ERROR read ERROR; OPEN native:read[(][)] OPEN @call_to_return; CLOSED native:read[(][)] ERROR @call_to_return; ERROR native:read[(][)] ERROR @call_to_return
AllocOutputStream | OutputStream | call close | OPEN | ERROR | return | OPEN close CLOSED; CLOSED close CLOSED; OPEN write OPEN; CLOSED write ERROR; ERROR write ERROR
AllocPrintStream | PrintStream | new | OPEN | ERROR OPEN | return | OPEN close CLOSED; CLOSED close CLOSED; ERROR close ERROR; OPEN public:(?!close$|<init>).* OPEN; CLOSED public:(?!close$|<init>).* ERROR; ERROR public:(?!close$|<init>).* ERROR
AllocPrintWriter | PrintWriter | new | OPEN | ERROR | return | OPEN close CLOSED; CLOSED close CLOSED; ERROR close ERROR; OPEN public:(?!close$|<init>).* OPEN; CLOSED public:(?!close$|<init>).* ERROR; ERROR public:(?!close$|<init>).* ERROR
"""
#: When a call changes the state: as its callee is entered, as it returns, as the caller goes past it.
CALL, RETURN, CALL_TO_RETURN, CALL_OR_CALL_TO_RETURN = "call", "return", "call_to_return", "call_or_call_to_return"
MOVES = "machine string, src string, over string, pattern string, dst string, at string, param int"


def machine_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(machine, cls, seed_kind, seed_name, initial, errors) and (machine, src, over, pattern, dst, at, param) of all machines.

    over: what the pattern matches: ``name``, ``sig``, ``public`` or ``native`` methods; param: THIS, or the argument's position.
    """
    heads, moves = [], []
    for line in MACHINES.strip().splitlines():
        name, cls, seed, initial, errors, at, steps = (x.strip() for x in line.split(" | "))
        kind, _, method = seed.partition(" ")
        heads.append((name, cls, kind, method or cls, initial, errors.split(" ")))
        for step in steps.split(";"):
            src, methods, dst, *own = step.split()
            over, _, pattern = methods.rpartition(":") if methods.split(":")[0] in ("sig", "public", "native") else ("name", "", methods)
            moves.append((name, src, over, pattern, dst, own[0][1:] if own else at, THIS))
    return spark.createDataFrame(heads, "machine string, cls string, seed_kind string, seed_name string, initial string, errors array<string>"), spark.createDataFrame(moves, MOVES)


def _of_class(rows: DataFrame, machines: DataFrame, subtypes: DataFrame) -> DataFrame:
    """rows (machine, type, ..) whose type is the machine's class, below it or unknown."""
    named = rows.join(machines.select("machine", "cls"), "machine")
    below = subtypes.select(F.col("sub").alias("type"), F.col("sup").alias("cls"), F.lit(True).alias("_below")).distinct()
    fits = F.col("type").isNull() | (F.col("type") == F.col("cls")) | F.coalesce("_below", F.lit(False))
    return named.join(below, ["type", "cls"], "left").filter(fits).select(*rows.columns)


def seeds(s: Solution, machines: DataFrame, subtypes: DataFrame) -> DataFrame:
    """(machine, qid, stmt, state): objects that each machine watches, from where, in its initial state.

    subtypes (sub, sup): reflexive and transitive. An object whose type is unknown is of any class. Allocations in static
    initialisers are not watched by machines that start at a ``new``.
    """
    p = s.program
    name = F.regexp_extract("sig", r"^[^(]*", 0)
    at = s.seeds.select("qid", "stmt", "type")
    started = p.stmt.join(p.method.filter("clinit").select("method"), "method", "left_semi").select("stmt")
    of = subtypes.select(F.col("sub").alias("type"), F.col("sup").alias("seed_name")).unionByName(at.select("type", F.col("type").alias("seed_name"))).distinct()
    made = at.join(started, "stmt", "left_anti").join(of, "type").join(F.broadcast(machines.filter("seed_kind = 'new'").select("machine", "seed_name", "initial")), "seed_name").select("machine", "qid", "stmt", "initial")
    calls = p.call.withColumn("name", name)
    edge = p.cfg_edge.select(F.col("src").alias("before"), F.col("dst").alias("stmt"))
    types = s.seeds.select("qid", "type")
    on = calls.select("stmt", F.col("recv").alias("val"), "name").join(edge, "stmt").join(s.points.withColumnRenamed("stmt", "before"), ["before", "val"]).join(types, "qid")
    called = _of_class(on.join(F.broadcast(machines.filter("seed_kind = 'call'").select("machine", "seed_name", "initial")), F.col("name") == F.col("seed_name")).select("machine", "qid", "type", F.col("before").alias("stmt"), "initial"), machines, subtypes)
    result = calls.select("stmt", F.col("lhs").alias("val"), "name").join(s.points, ["stmt", "val"]).join(types, "qid")
    result = _of_class(result.join(F.broadcast(machines.filter("seed_kind = 'result'").select("machine", "seed_name", "initial")), F.col("name") == F.col("seed_name")).select("machine", "qid", "type", "stmt", "initial"), machines, subtypes)
    cols = ["machine", "qid", "stmt", "initial"]
    return made.unionByName(called.select(*cols)).unionByName(result.select(*cols)).select("machine", "qid", "stmt", F.col("initial").alias("state")).distinct()


def matched_calls(p: Program, moves: DataFrame) -> DataFrame:
    """(stmt, val, sig, machine, src, dst, at, over): calls whose method a move matches, with the value that it acts on.

    Moves without the columns of machine_tables() are by name, act as the call returns, and on the receiver.
    """
    moves = moves.withColumns({c: F.lit(x) for c, x in (("machine", ""), ("over", "name"), ("at", RETURN), ("param", THIS)) if c not in moves.columns})
    own = p.call.filter("recv is not null").select("stmt", F.lit(THIS).alias("param"), F.col("recv").alias("val"), "sig")
    passed = p.arg.filter(F.col("pos") >= 0).join(p.call.select("stmt", "sig"), "stmt").select("stmt", F.col("pos").alias("param"), "val", "sig")
    native = p.call_edge.join(p.method.filter("native").select(F.col("method").alias("callee")), "callee").select(F.col("site").alias("stmt")).distinct().withColumn("native", F.lit(True))
    on = own.unionByName(passed).join(native, "stmt", "left").withColumns({"native": F.coalesce("native", F.lit(False)), "name": F.regexp_extract("sig", r"^[^(]*", 0)})
    # Few distinct signatures, few patterns: they are matched once each.
    kinds = on.select("sig", "name", "native", "param").distinct().join(F.broadcast(moves.withColumnRenamed("param", "m_param")), F.col("param") == F.col("m_param"))
    kinds = kinds.filter(((F.col("over") != "native") | F.col("native")) & F.expr("CASE WHEN over IN ('sig', 'native') THEN sig ELSE name END RLIKE concat('^(?:', pattern, ')$')"))
    return on.join(kinds.select("sig", "native", "param", "machine", "src", "dst", "at", "over"), ["sig", "native", "param"])


def changes(s: Solution, moves: DataFrame, machines: DataFrame | None = None, subtypes: DataFrame | None = None) -> DataFrame:
    """(machine, qid, stmt, src, dst, at, strong): state changes that calls cause on each allocation.

    strong where the value points to the one allocation alone, in each call context of it. With machines and subtypes, only calls on objects of the machine's class
    count. Moves over public methods leave out those that ``hidden`` lists for the object's type.
    """
    p = s.program
    edge = p.cfg_edge.select(F.col("src").alias("before"), F.col("dst").alias("stmt")).distinct()
    found = matched_calls(p, moves).join(edge, "stmt").join(s.points.withColumnRenamed("stmt", "before"), ["before", "val"]).select("stmt", "val", "qid", "sig", "machine", "src", "dst", "at", "over").distinct()
    found = found.join(s.seeds.select("qid", "type"), "qid")
    not_public = p.hidden.select("type", "sig", F.lit("public").alias("over")).distinct()
    found = found.join(not_public, ["type", "sig", "over"], "left_anti")
    if machines is not None and subtypes is not None:
        found = _of_class(found, machines, subtypes)
    alone = single_owners(s, found.select("stmt", "val").distinct())
    found = found.join(alone, ["qid", "stmt", "val"], "left").withColumn("alone", F.coalesce("alone", F.lit(False)))
    return found.groupBy("machine", "qid", "stmt", "src", "dst", "at").agg(F.bool_and("alone").alias("strong"))


def single_owners(s: Solution, at: DataFrame) -> DataFrame:
    """(qid, stmt, val, alone): objects that a value of at (stmt, val) holds before the statement, and whether it holds no other one in any of the
    object's call contexts.

    Objects are told apart by the calls open on their stacks, the innermost first: values that only one object has under the same open calls
    are settled, the others are looked at one call further up, until the stacks end or a call comes again.
    """
    edge = s.program.cfg_edge.select(F.col("src").alias("before"), F.col("dst").alias("stmt")).distinct()
    stack = written(s.calls.filter(F.col("label") != EPS).select("qid", "src", "label", "dst").join(s.seeds.select("qid"), "qid", "left_semi").distinct())
    facts = at.join(edge, "stmt").join(s.points.withColumnRenamed("stmt", "before"), ["before", "val"]).select("qid", "stmt", "val", "before")
    rows = facts.join(stack.select("qid", F.col("src").alias("val"), F.col("label").alias("before"), F.col("dst").alias("top")), ["qid", "val", "before"])
    rows = written(rows.select("qid", "stmt", "val", F.expr("cast(array() as array<string>)").alias("open"), "top").distinct())
    settled = []
    while True:
        owners = rows.groupBy("stmt", "val", "open").agg((F.count_distinct("qid") == 1).alias("one"), F.bool_or(F.col("top") == CALL_END).alias("whole"))
        told = written(rows.join(owners, ["stmt", "val", "open"]))
        # A stack that has ended may stand under any call; one that comes back to a call is not followed on.
        again = F.size("open") > F.size(F.array_distinct("open"))
        done = F.col("one") | F.col("whole") | again
        settled.append(told.filter(done).select("qid", "stmt", "val", F.col("one").alias("alone")))
        rest = told.filter(~done)
        up = rest.join(stack.select("qid", F.col("src").alias("top"), F.col("label").alias("site"), F.col("dst").alias("upper")), ["qid", "top"])
        rows, n = written_counted(up.select("qid", "stmt", "val", F.array_append("open", F.col("site")).alias("open"), F.col("upper").alias("top")).distinct())
        if not n:
            break
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    return out.groupBy("qid", "stmt", "val").agg(F.bool_and("alone").alias("alone"))


PATH = ["machine", "qid", "kind", "entry", "e_state", "stmt", "state", "up"]
AT, IN, OPEN = "at", "in", ""


@shuffled
def paths(s: Solution, start: DataFrame, moves: DataFrame, machines: DataFrame | None = None, subtypes: DataFrame | None = None, **limits) -> DataFrame:
    """Rows of two kinds. ``at``: an object that is in e_state as the method that begins at entry is entered may be in state after stmt; entry is
    empty where the object's way began in the method or further below, whose callers are any. ``in``: the call site stmt enters entry in
    e_state, from a caller that was itself entered at up in state.

    A return goes on in the callers whose entry it answers, and in no others. A method that an object does not reach is passed over.
    A call whose receiver can only be the one object replaces its state, any other may leave it as it is.
    """
    p = s.program
    steps = written(changes(s, moves, machines, subtypes))
    begins = start_points(p).select(F.col("method").alias("callee"), F.col("stmt").alias("begin"))
    calls = p.call_edge.select("site", "callee").join(begins, "callee").distinct()
    into = written(p.cfg_edge.select("src", F.col("dst").alias("site")).distinct().join(calls, "site"))
    back = written(p.call_edge.select("site", "callee").join(end_points(p).select(F.col("method").alias("callee"), F.col("stmt").alias("src")), "callee").join(begins, "callee").select("src", "site", "begin").distinct())
    plain = written(p.cfg_edge.select("src", F.col("dst").alias("site")).distinct().join(calls.select("site"), "site", "left_anti"))
    inside = written(s.reached.join(p.stmt.select("stmt", F.col("method").alias("callee")), "stmt").select("qid", "callee").distinct())
    held_at = written(s.reached.select("qid", F.col("stmt").alias("site")).distinct())
    ways = F.when(F.col("at") == CALL, F.array(F.lit("into"), F.lit("over"))).when(F.col("at") == CALL_OR_CALL_TO_RETURN, F.array(F.lit("into"), F.lit("over"))).otherwise(F.array(F.lit("back"), F.lit("over")))
    acts = written(steps.select("machine", "qid", F.col("stmt").alias("site"), F.col("src").alias("state"), "dst", "strong", F.explode(ways).alias("way")).distinct())
    key = ["machine", "qid", "site", "way", "state"]
    # What a state becomes at a site: itself, unless a strong update replaces it, and what the moves make of it.
    turned = acts.groupBy(*key).agg(F.collect_set("dst").alias("to"), F.bool_or("strong").alias("strong"))

    def moved(rows: DataFrame) -> DataFrame:
        """rows (machine, qid, site, way, state, ..) with each state that they may have behind the site."""
        met = rows.join(turned, key, "left")
        after = F.when(F.col("to").isNull(), F.array("state")).when(F.col("strong"), F.col("to")).otherwise(F.array_union(F.col("to"), F.array("state")))
        return met.withColumn("after", F.explode(after)).drop("to", "strong")

    as_rows = lambda df, kind, entry, e_state, stmt, state, up: df.select("machine", "qid", F.lit(kind).alias("kind"), entry.alias("entry"), e_state.alias("e_state"), stmt.alias("stmt"), state.alias("state"), up.alias("up"))
    c, none = F.col, F.lit(OPEN)

    def step(total: DataFrame, delta: DataFrame) -> DataFrame:
        here = delta.filter(c("kind") == AT).drop("kind", "up").withColumnRenamed("stmt", "src")
        met = here.join(into, "src").join(inside.withColumn("enters", F.lit(True)), ["qid", "callee"], "left")
        passed = here.join(plain, "src").select("machine", "qid", "entry", "e_state", "site", "state").unionByName(met.filter("enters IS NULL").select("machine", "qid", "entry", "e_state", "site", "state"))
        over = moved(passed.distinct().withColumn("way", F.lit("over")))
        out = as_rows(over, AT, c("entry"), c("e_state"), c("site"), c("after"), none)
        entered = moved(met.filter("enters").select("machine", "qid", "entry", "e_state", "site", "state", "begin").distinct().withColumn("way", F.lit("into")))
        out = out.unionByName(as_rows(entered, AT, c("begin"), c("after"), c("begin"), c("after"), none)).unionByName(as_rows(entered, IN, c("begin"), c("after"), c("site"), c("e_state"), c("entry")))

        def answered(ends: DataFrame, asked: DataFrame) -> DataFrame:
            ends = ends.filter((c("kind") == AT) & (c("entry") != OPEN)).select("machine", "qid", "entry", "e_state", c("stmt").alias("src"), "state").join(back, "src").filter(c("begin") == c("entry"))
            asked = asked.filter(c("kind") == IN).select("machine", "qid", "entry", "e_state", c("stmt").alias("site"), c("state").alias("c_state"), c("up").alias("c_entry"))
            return ends.join(asked, ["machine", "qid", "entry", "e_state", "site"]).select("machine", "qid", "site", "state", c("c_entry").alias("entry"), c("c_state").alias("e_state"))

        opened = here.filter(c("entry") == OPEN).join(back, "src").join(held_at, ["qid", "site"], "left_semi").select("machine", "qid", "site", "state", "entry", "e_state")
        returned = moved(answered(delta, total).unionByName(answered(total, delta)).unionByName(opened).distinct().withColumn("way", F.lit("back")))
        return out.unionByName(as_rows(returned, AT, c("entry"), c("e_state"), c("site"), c("after"), none))

    first = as_rows(start, AT, none, none, c("stmt"), c("state"), none)
    return fixpoint(first, step, keys=PATH, **limits).whole()


def states(s: Solution, start: DataFrame, moves: DataFrame, machines: DataFrame | None = None, subtypes: DataFrame | None = None, **limits) -> DataFrame:
    """(machine, qid, stmt, state): states that an object may be in after each statement, in whatever call context.

    A move at ``call`` acts as the callee is entered, one at ``return`` or ``call_to_return`` as the call is left, one at
    ``call_or_call_to_return`` at either. A call without a body is entered and left at once.
    """
    return paths(s, start, moves, machines, subtypes, **limits).filter(F.col("kind") == AT).select("machine", "qid", "stmt", "state").distinct()


def final_states(s: Solution, walked: DataFrame) -> DataFrame:
    """(machine, qid, stmt, state): of paths(), the states at the end of methods that an object does not return from: its way began there or
    further below, and no caller holds it."""
    p = s.program
    held_at = s.reached.select("qid", F.col("stmt").alias("site")).distinct()
    leaves = p.call_edge.select("site", "callee").join(end_points(p).select(F.col("method").alias("callee"), "stmt"), "callee").join(held_at, "site").select("qid", "stmt").distinct()
    own = walked.filter((F.col("kind") == AT) & (F.col("entry") == OPEN)).select("machine", "qid", "stmt", "state")
    return own.join(end_points(p).select("stmt"), "stmt", "left_semi").join(leaves, ["qid", "stmt"], "left_anti").distinct()


def verdicts(found: DataFrame, machines: DataFrame, exits: DataFrame | None = None) -> DataFrame:
    """(machine, qid, error): whether an object may be in an error state at one of exits (stmt); without exits, at any statement of found."""
    at = found if exits is None else found.join(exits.select("stmt").distinct(), "stmt", "left_semi")
    at = at.join(machines.select("machine", "errors"), "machine")
    return at.groupBy("machine", "qid").agg(F.bool_or(F.array_contains("errors", F.col("state"))).alias("error"))


@shuffled
def judged(p: Program, names: list[str], options: Options = Options(), *, anywhere: bool = False, budget: Budget | None = None, report: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """(machine, qid, stmt, val, error, timed_out): the verdict on every object that the machines of these names watch; all seeds are solved
    in one batch, within options.timeout_seconds for all and budget for each, beyond which an object is marked timed_out.

    An object is in error if it may be in an error state where it ends (final_states()), or, with anywhere, after any statement. error is null
    for an object that reaches no end. report gets the table before it is returned.
    """
    machines, moves = machine_tables(p.spark)
    machines, moves = (t.filter(F.col("machine").isin(*names)) for t in (machines, moves))
    s = solve(p, None, options, budget=budget)
    subtypes = subtype_closure(p)
    start = written(seeds(s, machines, subtypes))
    walked = paths(s, start, moves, machines, subtypes)
    told = verdicts(walked.filter(F.col("kind") == AT).select("machine", "qid", "stmt", "state") if anywhere else final_states(s, walked), machines)
    watched = start.select("machine", "qid").distinct().join(s.seeds.select("qid", "stmt", "val"), "qid")
    late = F.lit(s.timed_out)
    if s.exhausted is not None:
        watched = watched.join(s.exhausted.select("qid", F.lit(True).alias("ended")), "qid", "left")
        late = late | F.col("ended").isNotNull()
    out = written(watched.join(told, ["machine", "qid"], "left").select("machine", "qid", "stmt", "val", "error", late.alias("timed_out")))
    if report:
        report(out)
    return out


def must_may(found: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (machine, qid, stmt, state) with may (in the state possibly) and must (in no other)."""
    per = found.groupBy("machine", "qid", "stmt").agg(F.collect_set("state").alias("held"))
    out = asked.join(per, ["machine", "qid", "stmt"], "left")
    may = F.coalesce(F.array_contains("held", F.col("state")), F.lit(False))
    return out.withColumn("may", may).withColumn("must", may & (F.size("held") == 1)).drop("held")


def fold_machine(events: DataFrame, moves: DataFrame, initial: str, *, block: int = 1024) -> DataFrame:
    """events (qid, ord, name) and moves (src, name, dst) -> (qid, state, visited): state after all events in
    order, and the set of states on the way, the first included. A name without a move from a state keeps it.

    Events are sorted over all tasks, by ranges of object and order, and cut into blocks; a block is folded once for every state
    it may start in, and blocks are chained by their changes, so that no task needs all events of an object.
    """
    names = [r["s"] for r in moves.select(F.explode(F.array("src", "dst")).alias("s")).distinct().unionByName(moves.sparkSession.createDataFrame([(initial,)], "s string")).distinct().orderBy("s").collect()]  # a machine's states
    table = F.create_map(*[x for r in moves.collect() for x in (F.lit(f"{r['src']}\u0001{r['name']}"), F.lit(r["dst"]))])
    ordered = events.select("qid", "ord", "name").repartitionByRange("qid", "ord").sortWithinPartitions("qid", "ord", "name")
    nth = F.monotonically_increasing_id()  # rises in order through all partitions
    parts = ordered.select("qid", "name", nth.alias("ord")).withColumn("block", F.floor(F.col("ord") / block))
    parts = parts.groupBy("qid", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda e: e["name"]).alias("names"))
    go = lambda s, name: F.coalesce(table[F.concat(s, F.lit("\u0001"), name)], s)

    def run(s: str):
        start = F.struct(F.lit(s).alias("at"), F.array(F.lit(s)).alias("seen"))
        return F.aggregate("names", start, lambda acc, name: F.struct(go(acc["at"], name).alias("at"), F.array_union(acc["seen"], F.array(go(acc["at"], name))).alias("seen")))

    blocks = parts.select("qid", "block", F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(run, names))).alias("f"))
    chain = blocks.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("block", F.map_entries("f").alias("f")))).alias("fs"))
    first = F.struct(F.lit(initial).alias("at"), F.array(F.lit(initial)).alias("seen"))
    pick = lambda acc, b: F.filter(b["f"], lambda e: e["key"] == acc["at"])[0]["value"]
    folded = F.aggregate("fs", first, lambda acc, b: F.struct(pick(acc, b)["at"].alias("at"), F.array_union(acc["seen"], pick(acc, b)["seen"]).alias("seen")))
    return chain.select("qid", folded.alias("r")).select("qid", F.col("r.at").alias("state"), F.array_sort("r.seen").alias("visited"))
