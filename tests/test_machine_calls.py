"""What each machine does at calls of its class: a list of its own, compared with what the machine table matches."""

from pushgraph.operators import typestate as Y
from pushgraph.sources.ir import Program

SIGNATURE = (
    "getInstance(String): NONE>UNITIALIZED; initSign(PrivateKey): UNITIALIZED>SIGN_CHECK SIGN_CHECK>SIGN_CHECK VERIFY_CHECK>SIGN_CHECK ERROR>ERROR;"
    "initVerify(PublicKey): UNITIALIZED>VERIFY_CHECK SIGN_CHECK>VERIFY_CHECK VERIFY_CHECK>VERIFY_CHECK ERROR>ERROR; sign(): UNITIALIZED>ERROR SIGN_CHECK>SIGN_CHECK VERIFY_CHECK>ERROR ERROR>ERROR;"
    "verify(byte[]): UNITIALIZED>ERROR SIGN_CHECK>ERROR VERIFY_CHECK>VERIFY_CHECK ERROR>ERROR; update(byte[]): UNITIALIZED>ERROR SIGN_CHECK>SIGN_CHECK VERIFY_CHECK>VERIFY_CHECK ERROR>ERROR; getAlgorithm():"
)
# Machine; when its calls act; for calls, the states that they lead from and to. A call without any does nothing.
CALLS = {
    "FileMustBeClosed": ("call", "open(): INIT>OPENED; reopen(int): INIT>OPENED; close(): INIT>CLOSED OPENED>CLOSED; read():"),
    "FileMustBeClosedCallToReturn": ("call_to_return", "open(): INIT>OPENED; close(): INIT>CLOSED OPENED>CLOSED; read():"),
    "HasNext": ("return", "next(): INIT>ERROR HASNEXT>INIT ERROR>ERROR; hasNext(): INIT>HASNEXT HASNEXT>HASNEXT ERROR>ERROR; remove():"),
    "Vector": (
        "return",
        "add(Object): INIT>NOT_EMPTY; addAll(Collection): INIT>NOT_EMPTY; setElementAt(Object,int): INIT>NOT_EMPTY; <init>(java.util.Collection): INIT>NOT_EMPTY; <init>():;"
        "get(int): INIT>ACCESSED_EMPTY NOT_EMPTY>NOT_EMPTY ACCESSED_EMPTY>ACCESSED_EMPTY; firstElement(): INIT>ACCESSED_EMPTY NOT_EMPTY>NOT_EMPTY ACCESSED_EMPTY>ACCESSED_EMPTY;"
        "removeAllElements(): INIT>INIT NOT_EMPTY>INIT; size():",
    ),
    "KeyStore": ("call_to_return", "load(InputStream): INIT>LOADED; getKey(String): INIT>ERROR LOADED>LOADED ERROR>ERROR; size(): INIT>ERROR LOADED>LOADED ERROR>ERROR"),
    "Signature": ("return", SIGNATURE),
    "Socket": ("return", "connect(SocketAddress): INIT>CONNECTED CONNECTED>CONNECTED ERROR>ERROR; getInputStream(): INIT>ERROR CONNECTED>CONNECTED ERROR>ERROR; isClosed():; <init>():"),
    "URLConn": ("return", "setDoInput(boolean): CONNECTED>ERROR ERROR>ERROR; addRequestProperty(String): CONNECTED>ERROR ERROR>ERROR; getContent():"),
    "InputStream": ("return", "close(): NONE>CLOSED CLOSED>CLOSED; read(byte[]): CLOSED>ERROR ERROR>ERROR; read(): CLOSED>ERROR ERROR>ERROR CLOSED>ERROR@call_to_return ERROR>ERROR@call_to_return; skip(long):"),
    "OutputStream": ("return", "close(): NONE>CLOSED CLOSED>CLOSED; write(int): CLOSED>ERROR ERROR>ERROR; flush():"),
    "PipedInputStream": ("return", "connect(PipedOutputStream): INIT>CONNECTED; read(): INIT>ERROR CONNECTED>CONNECTED ERROR>ERROR; close():"),
    "PipedOutputStream": ("return", "connect(PipedInputStream): INIT>CONNECTED; write(int): INIT>ERROR CONNECTED>CONNECTED ERROR>ERROR; close():"),
    "PrintStream": ("return", "close(): CLOSED>CLOSED; println(String): CLOSED>ERROR"),
    "PrintWriter": ("return", "close(): NONE>CLOSED CLOSED>CLOSED; println(String): CLOSED>ERROR ERROR>ERROR"),
    "AllocInputStream": ("return", "close(): OPEN>CLOSED CLOSED>CLOSED ERROR>ERROR; read(byte[]): OPEN>OPEN CLOSED>ERROR ERROR>ERROR; read(): OPEN>OPEN CLOSED>ERROR ERROR>ERROR; skip(long):"),
    "AllocOutputStream": ("return", "close(): OPEN>CLOSED CLOSED>CLOSED; write(int): OPEN>OPEN CLOSED>ERROR ERROR>ERROR; flush():"),
    "AllocPrintStream": ("return", "close(): OPEN>CLOSED CLOSED>CLOSED ERROR>ERROR; println(String): OPEN>OPEN CLOSED>ERROR ERROR>ERROR; <init>(File):"),
    "AllocPrintWriter": ("return", "close(): OPEN>CLOSED CLOSED>CLOSED ERROR>ERROR; println(String): OPEN>OPEN CLOSED>ERROR ERROR>ERROR; <init>(File):"),
}
#: Calls of native methods, which some machines tell from others.
NATIVE = {("AllocInputStream", "read()"): {("OPEN", "OPEN"), ("CLOSED", "ERROR"), ("ERROR", "ERROR")}}


def test_calls_of_every_machine(spark):
    machines, moves = Y.machine_tables(spark)
    assert {r["machine"] for r in machines.collect()} == set(CALLS)
    want, calls = set(), []
    for machine, (at, text) in CALLS.items():
        for part in text.split(";"):
            sig, _, steps = part.strip().partition(": ")
            sig = sig.rstrip(":")
            calls.append((f"{machine} {sig}", "o", sig, "virtual", None))
            for step in steps.split():
                step, _, own = step.partition("@")
                want.add((machine, sig, *step.split(">"), own or at))
    for (machine, sig), steps in NATIVE.items():
        calls.append((f"{machine} native {sig}", "o", sig, "virtual", None))
        want |= {(machine, f"native {sig}", *x, y) for x in steps for y in ("return", "call_to_return")}
    p = Program.of(spark, call=calls, call_edge=[(c[0], "m", "nat", "virtual") for c in calls if " native " in c[0]], method=[("nat", "C", False, False, True, False, False, True)])
    rows = Y.matched_calls(p, moves).collect()
    got = {(r["machine"], r["stmt"].partition(" ")[2], r["src"], r["dst"], r["at"]) for r in rows if r["stmt"].partition(" ")[0] == r["machine"]}
    assert got - want == set() and want - got == set()
