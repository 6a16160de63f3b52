"""Scanners of program text: blocks, calls, imports, exports, structs and declarations as rows.

Each scanner is a small helper over the tokens of one file; Spark deals the files. ``scan_facts`` reads each text once and gives the
facts of all kinds.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.lexer import NAME, SIGN, STRING, Tokens

#: Words before a bracket that are no function names.
KEYWORDS = frozenset(("if", "for", "while", "switch", "catch", "return", "typeof", "instanceof", "new", "delete"))
#: Type names that stand for what they wrap.
WRAPPERS = frozenset(("Promise", "Array", "ReadonlyArray", "AsyncCallback", "Callback", "Record", "Partial", "Required", "Pick", "Omit", "Map", "Set"))
#: Words that may stand before a function's name, and before a declaration's.
MODIFIERS = frozenset(("export", "public", "private", "protected", "async", "static", "readonly", "abstract", "override", "function", "const", "let", "var"))
DECLARED = frozenset(("export", "default", "declare", "static", "readonly", "public", "async", "abstract"))
CONTAINERS = frozenset(("namespace", "class", "interface", "enum"))
#: Characters between a parameter list and the arrow of a function, at most.
ARROW = 400


def tokens_of(text: str | Tokens) -> Tokens:
    return text if isinstance(text, Tokens) else Tokens(text)


def matching(text: str, at: int) -> int | None:
    """Where the bracket at ``at`` closes."""
    t = Tokens(text)
    return next((t.start[c] for o, c in t.close.items() if t.start[o] == at), None)


def _body(t: Tokens, close: int, arrow: bool) -> int | None:
    """The brace that begins a function's body behind its parameters, which end at ``close``: past a type, if there is one."""
    k, typed = close + 1, t.is_(close + 1, ":")
    if arrow:
        while k < len(t) and t.start[k] <= t.end[close] + ARROW:
            if t.is_(k, "=>"):
                return k + 1 if t.is_(k + 1, "{") else None
            if t.is_(k, "=", "{", "}", ";") or not (typed or k == close + 1):
                return None
            k = t.close.get(k, k) + 1
        return None
    if t.is_(k, "{"):
        return k
    if not typed:
        return None
    k += 1
    while k < len(t):
        if t.is_(k, "{"):
            end = t.close.get(k)
            return end + 1 if end is not None and t.is_(end + 1, "{") else k
        if t.is_(k, ";", "=", "=>", "==", "===", "}"):
            return None
        k = t.close.get(k, k) + 1
    return None


def _blocks(t: Tokens) -> Iterator[tuple[int, int, int]]:
    """(name, opening brace, closing brace), as numbers of tokens."""
    seen = set()
    for k in range(len(t)):
        if t.kind[k] != NAME or not t.first(k):
            continue
        while t.value[k] in MODIFIERS and t.named(k + 1):
            k += 1
        n, arrow = k + 1, False
        if t.is_(n, "<") and (past := t.past_types(n)):
            n = past
        if t.is_(n, "="):
            n, arrow = n + 1 + t.is_(n + 1, "async"), True
        if t.value[k] in KEYWORDS or not t.is_(n, "(") or (close := t.close.get(n)) is None:
            continue
        body = _body(t, close, arrow)
        if body is None or (end := t.close.get(body)) is None or (t.value[k], body) in seen:
            continue
        seen.add((t.value[k], body))
        yield k, body, end


def blocks(text: str | Tokens) -> Iterator[tuple]:
    """(name, pos, start_line, end_line, body_start, body_end) of everything that has a name, brackets and a body."""
    t = tokens_of(text)
    for k, body, end in _blocks(t):
        yield t.value[k], t.start[k], t.line(t.start[k]), t.line(t.start[end]), t.start[body], t.start[end]


def _heads(t: Tokens, known: list[tuple[int, int, int]]) -> set[int]:
    """The names of blocks that are no calls: those declared with ``function``, and those within no other block."""
    out, around = set(), []
    for k, _, end in sorted(known):
        while around and around[-1] < k:
            around.pop()
        if not around or t.is_(k - 1, "function") or (t.is_(k - 1, "*") and t.is_(k - 2, "function")):
            out.add(k)
        around.append(end)
    return out


def _cast(t: Tokens, a: int, b: int) -> int | None:
    """Where an ``as`` stands among the tokens from ``a`` to ``b``, outside of brackets."""
    k = a + 1
    while k < b:
        if t.is_(k, "as"):
            return k
        k = t.close.get(k, k) + 1
    return None


def _inside(t: Tokens, opened: int) -> tuple[int, int]:
    """The tokens within brackets, without further brackets around all, await before, assertions behind."""
    a, b = opened + 1, t.close[opened]
    while a < b:
        if t.is_(a, "await"):
            a += 1
        elif t.is_(a, "(") and t.close.get(a) == b - 1:
            a, b = a + 1, b - 1
        elif t.is_(b - 1, "!"):
            b -= 1
        elif (cast := _cast(t, a, b)) is not None:
            b = cast
        else:
            break
    return a, b


class _Callee:
    """What a call calls: where its expression begins, its base, dotted chain and last name."""

    __slots__ = ("base", "chain", "first", "name", "new")

    def __init__(self, first: int, base: str, chain: str, name: str, new: bool):
        self.first, self.base, self.chain, self.name, self.new = first, base, chain, name, new


def _callee(t: Tokens, opened: int, known: dict[int, _Callee]) -> _Callee | None:
    """Read backwards from a call's bracket: names and dots, then a name, a call or what brackets hold."""
    k = opened - 1
    if t.is_(k, ">"):
        k = t.before_types(k)
        if k is None:
            return None
    if t.is_(k, "?."):
        k -= 1
    if not t.named(k):
        return None
    names = [t.value[k]]
    while t.is_(k - 1, ".", "?."):
        k -= 2
        while t.is_(k, "!"):
            k -= 1
        if t.named(k):
            names.append(t.value[k])
        elif t.is_(k, ")") and (inner := t.open.get(k)) is not None:
            said = known.get(k)
            if said is None:  # not a call: brackets around something
                a, b = _inside(t, inner)
                if a + 1 == b and t.named(a):
                    names.append(t.value[a])
                    k = inner
                    break
                said = known.get(b - 1) if t.is_(b - 1, ")") else None
                if said is None or said.first != a - t.is_(a - 1, "new"):
                    said = None
                base = f"{_called(said)}()" if said else "()"
                return _Callee(inner, base, ".".join([base, *reversed(names)]), names[0], False)
            base = f"{_called(said)}()"
            return _Callee(said.first, base, ".".join([base, *reversed(names)]), names[0], False)
        else:
            first = t.open.get(k, k)
            return _Callee(first, "", ".".join(["", *reversed(names)]), names[0], False)
    names.reverse()
    new = t.is_(k - 1, "new")
    return _Callee(k - new, names[0], ".".join(names), names[-1], new)


def _called(call: _Callee) -> str:
    """The name by which a call that is itself called upon is known: its chain, or only the last step of a longer one."""
    return call.chain if "()" not in call.chain and call.base else f".{call.name}"


def _target(t: Tokens, first: int, end: int) -> tuple[str | None, bool]:
    """(variable, declared) that a call, from token ``first`` to ``end``, is set to as a whole, past brackets, await and assertions."""
    k, n = first - 1, end + 1
    while True:
        if t.is_(k, "await"):
            k -= 1
        elif t.is_(k, "(") and t.close.get(k) == n:
            k, n = k - 1, n + 1
        elif t.is_(k, ">") and (before := t.before_types(k)) is not None and t.is_(before, "=", "(", "await"):
            k = before
        elif t.is_(n, "!"):
            n += 1
        elif t.is_(n, "as") and t.named(n + 1):
            n += 2
            while t.is_(n, ".") and t.named(n + 1):
                n += 2
            if t.is_(n, "<"):
                n = t.past_types(n) or n
        else:
            break
    goes_on = n < len(t) and not t.is_(n, ";", ",", ")", "]", "}") and (t.line(t.start[n]) == t.line(t.end[n - 1]) or (t.kind[n] == SIGN and t.value[n] not in ("@", "{", "(", "[", "++", "--", "!")))
    if not t.is_(k, "=") or goes_on:
        return None, False
    name, back = k - 1, k - 1
    while back > 0 and t.line(t.start[back]) == t.line(t.start[k]) and not t.is_(back, ";", "{", "=", ","):
        if t.is_(back, ":") and t.named(back - 1):
            name = back - 1  # a type stands between
        back = t.open.get(back, back) - 1
    while t.is_(name, ")") and (inner := t.open.get(name)) is not None and name - inner == 2:
        name -= 1
    if not t.named(name) or t.is_(name - 1, ".", "?."):
        return None, False
    return t.value[name], t.is_(name - 1, "const", "let", "var")


def calls(text: str | Tokens) -> Iterator[tuple]:
    """(pos, end, line, code, base, chain, callee, is_new, assigned, declared) of every call; ``chain`` is what is called, dotted.

    A call begins where its whole expression does. What begins a block is a call too if it lies in another block and isn't declared with
    ``function``, as elements with children are. Names in brackets behind a value, as in ``x[go]()``, are called by that name.
    """
    t = tokens_of(text)
    heads, known = _heads(t, list(_blocks(t))), {}
    for opened in sorted(o for o in t.close if t.value[o] == "("):
        end = t.close[opened]
        if t.is_(opened - 1, "]") and t.open.get(opened - 1) == opened - 3 and t.named(opened - 2) and (t.named(opened - 4) or t.is_(opened - 4, ")", "]")):
            at = t.start[opened - 3]
            yield at, t.end[end], t.line(at), t.code(t.line(at)), "", f"[{t.value[opened - 2]}]", t.value[opened - 2], False, None, False
            continue
        call = _callee(t, opened, known)
        if call is None or call.name in KEYWORDS or call.first in heads or (call.chain == "async" and t.is_(end + 1, "=>", ":")):
            continue
        known[end] = call
        at = t.start[call.first]
        assigned, declared = _target(t, call.first, end)
        yield at, t.end[end], t.line(at), t.code(t.line(at)), call.base, call.chain, call.name, call.new, assigned, declared


def _list(t: Tokens, opened: int) -> Iterator[tuple[str, str]]:
    """(name, alias) of a list in braces, types left out."""
    k = opened + 1
    while k < t.close[opened]:
        stop = next(j for j in range(k, t.close[opened] + 1) if j == t.close[opened] or t.is_(j, ","))
        part = [t.value[j] for j in range(k, stop)]
        if part and not (part[0] == "type" and len(part) > 1 and part[1] != "as"):
            yield part[0], part[2] if len(part) == 3 and part[1] == "as" else part[0]
        k = stop + 1


def imports(text: str | Tokens) -> Iterator[tuple]:
    """(module, kind, imported, local, line, code): imports that aren't of types only, each with its whole statement."""
    t = tokens_of(text)
    for k in range(len(t)):
        if not t.is_(k, "import") or not (t.first(k) or t.is_(k - 1, ";", "}")) or t.is_(k + 1, "(", "."):
            continue
        n, found = k + 1, []
        if t.is_(n, "type") and not t.is_(n + 1, "from", ","):
            continue
        while n < len(t) and t.kind[n] != STRING:
            if t.is_(n, "{") and n in t.close:
                found += [("named", a, b) for a, b in _list(t, n)]
                n = t.close[n] + 1
            elif t.is_(n, "*") and t.is_(n + 1, "as") and t.named(n + 2):
                found.append(("namespace", "*", t.value[n + 2]))
                n += 3
            elif t.is_(n, ",", "from"):
                n += 1
            elif t.named(n):
                found.append(("default", "default", t.value[n]))
                n += 1
            else:
                break
        if n < len(t) and t.kind[n] == STRING and t.is_(n - 1, "from"):
            code = t.text[t.start[k] : t.end[n + 1] if t.is_(n + 1, ";") else t.end[n]]
            for kind, imported, local in found:
                yield t.value[n][1:-1], kind, imported, local, t.line(t.start[k]), code


def exports(text: str | Tokens) -> Iterator[tuple]:
    """(exported, local, module, pos) of export lists; module is null without a from."""
    t = tokens_of(text)
    for k in range(len(t)):
        if t.is_(k, "export") and t.is_(k + 1, "{") and (end := t.close.get(k + 1)) is not None:
            module = t.value[end + 2][1:-1] if t.is_(end + 1, "from") and end + 2 < len(t) and t.kind[end + 2] == STRING else None
            for n, (local, exported) in enumerate(_list(t, k + 1)):
                yield exported, local, module, t.start[k] + n


def defaults(text: str | Tokens) -> Iterator[tuple]:
    """(name): the name that a file exports as its default, if it is a name."""
    t = tokens_of(text)
    for k in range(len(t)):
        if t.is_(k, "export") and t.is_(k + 1, "default") and t.named(k + 2) and (k + 3 >= len(t) or t.is_(k + 3, ";") or t.first(k + 3)):
            yield (t.value[k + 2],)
            return


def structs(text: str | Tokens) -> Iterator[tuple]:
    """(name, start_line, end_line, is_default)."""
    t = tokens_of(text)
    for k in range(len(t)):
        if t.is_(k, "struct") and t.named(k + 1) and t.is_(k + 2, "{") and (end := t.close.get(k + 2)) is not None:
            yield t.value[k + 1], t.line(t.start[k + 1]), t.line(t.start[end]), t.is_(k - 1, "default") and t.is_(k - 2, "export")


def return_types(text: str) -> list[str]:
    """Names in a type, wrappers replaced by what they wrap; unions, intersections and arrays taken apart."""
    text = text.strip()
    while text.startswith("(") and matching(text, 0) == len(text) - 1:
        text = text[1:-1].strip()
    parts, depth, piece = [], 0, ""
    for c in text:
        depth += (c in "<([{") - (c in ">)]}")
        if c in "|&," and depth == 0:
            parts.append(piece)
            piece = ""
        else:
            piece += c
    parts.append(piece)
    if len(parts) > 1:
        return list(dict.fromkeys(x for p in parts for x in return_types(p)))
    if text.endswith("[]"):
        return return_types(text[:-2])
    m = re.fullmatch(r"(?:[\w$]+\.)*([A-Za-z_$][\w$]*)\s*(?:<(.*)>)?", text, re.S)
    if not m:
        return []
    return return_types(m[2]) if m[1] in WRAPPERS and m[2] else [m[1]]


def _said(comment: str) -> tuple[str, list[str]]:
    """(summary, permissions) of a documentation comment: its first text, and the names behind its ``@permission`` tags."""
    told = [x.strip(" *\t\r") for x in comment[3:].removesuffix("*/").split("\n")]
    summary = next((x for x in told if x and not x.startswith("@")), "")
    return summary, sorted({p for x in told if x.startswith("@permission") for p in re.findall(r"ohos\.permission\.[A-Za-z0-9_]+", x)})


def declarations(text: str | Tokens) -> Iterator[tuple]:
    """(container, member, kind, summary, permissions, returns, line) of a declaration file.

    The documentation comment right before a declaration gives its summary and permissions.
    """
    t = tokens_of(text)
    starts = [a for a, _ in t.comments]
    inside: list[tuple[int, str]] = []
    k = comment = 0
    while k < len(t):
        while inside and k > inside[-1][0]:
            inside.pop()
        at = k
        if t.kind[k] != NAME or not t.first(k):
            k += 1
            continue
        while t.value[k] in DECLARED and t.named(k + 1):
            k += 1
        kind = t.value[k] if t.value[k] in CONTAINERS | {"function", "const"} and t.named(k + 1) else None
        k += kind is not None
        n = k + 1
        if t.is_(n, "?"):
            n += 1
        if t.is_(n, "<") and (past := t.past_types(n)):
            n = past
        if t.value[k] in KEYWORDS or t.value[k] in ("import", "export", "from") or not t.is_(n, "(", "{", "extends", "implements", ":"):
            k = at + 1
            continue
        while comment < len(starts) and starts[comment] < t.start[at]:
            comment += 1
        a, b = t.comments[comment - 1] if comment else (0, 0)
        own = comment > 0 and not t.text[b : t.start[at]].strip() and t.text.startswith("/**", a)
        summary, permissions = _said(t.text[a:b]) if own else ("", [])
        returns: list[str] = []
        close = t.close.get(n) if t.is_(n, "(") else None
        if close is not None and t.is_(close + 1, ":"):
            stop = close + 2
            while stop < len(t) and not t.is_(stop, ";", "{", "}") and not (stop > close + 2 and t.line(t.start[stop]) > t.line(t.end[stop - 1]) and not t.is_(stop, "|", "&")):
                stop = t.close.get(stop, stop) + 1
            returns = return_types(t.text[t.start[close + 2] : t.end[stop - 1]]) if stop > close + 2 else []
        yield ".".join(x for _, x in inside), t.value[k], kind or ("method" if t.is_(n, "(") else "property"), summary, permissions, returns, t.line(t.start[k])
        if kind in ("namespace", "class", "interface"):
            while n < len(t) and not t.is_(n, "{", ";"):
                n += 1
            if n in t.close:
                inside.append((t.close[n], t.value[k]))
                k = n
        elif close is not None:
            k = close
        k += 1


#: Columns of the facts of each kind, and what finds them.
FACTS: dict[str, tuple[Callable[[Tokens], Iterator[tuple]], str]] = {
    "block": (blocks, "name string, pos int, start_line int, end_line int, body_start int, body_end int"),
    "call": (calls, "pos int, end int, line int, code string, base string, chain string, callee string, is_new boolean, assigned string, declared boolean"),
    "import": (imports, "module string, kind string, imported string, local string, import_line int, import_code string"),
    "export": (exports, "exported string, local string, module string, pos int"),
    "default": (defaults, "name string"),
    "struct": (structs, "name string, start_line int, end_line int, is_default boolean"),
    "declaration": (declarations, "container string, member string, kind string, summary string, permissions array<string>, returns array<string>, line int"),
}
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
#: Rows of an Arrow batch of facts.
ROWS = 10_000


def scan_facts(files: DataFrame, *kinds: str) -> DataFrame:
    """(path, fact, and a struct for each kind) of all files (path, text): each text goes to Python and through the lexer once; null texts give none.

    A row has the struct of its own kind and null in the others, so a reader of one kind reads those columns only.
    """
    names = {k: [c.split()[0] for c in FACTS[k][1].split(", ")] for k in kinds}
    types = {k: pa.struct([(c.split()[0], _ARROW[c.split()[1]]) for c in FACTS[k][1].split(", ")]) for k in kinds}

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())]
        columns += [pa.array([dict(zip(names[k], r[2])) if r[1] == k else None for r in rows], types[k]) for k in kinds]
        return pa.RecordBatch.from_arrays(columns, names=["path", "fact", *(f"{k}_fact" for k in kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text:
                    t = Tokens(text)
                    for k in kinds:
                        for fact in FACTS[k][0](t):
                            rows.append((path, k, fact))
                            if len(rows) >= ROWS:
                                yield batch(rows)
                                rows = []
        if rows:
            yield batch(rows)

    schema = ", ".join(["path string", "fact string", *(f"{k}_fact struct<{', '.join(c.replace(' ', ': ', 1) for c in FACTS[k][1].split(', '))}>" for k in kinds)])
    return files.select(F.col("path").cast("string"), F.col("text").cast("string")).mapInArrow(run, schema)


def facts_of(facts: DataFrame, kind: str) -> DataFrame:
    """(path, and the columns of ``kind``) of scanned facts."""
    return facts.where(F.col("fact") == kind).select("path", f"{kind}_fact.*")


def _deal(kind: str) -> Callable[[DataFrame], DataFrame]:
    def over(files: DataFrame) -> DataFrame:
        """Rows of every file of (path, text); null texts give none."""
        return facts_of(scan_facts(files, kind), kind)

    return over


scan_blocks, scan_calls, scan_imports, scan_exports = _deal("block"), _deal("call"), _deal("import"), _deal("export")
scan_defaults, scan_structs, scan_declarations = _deal("default"), _deal("struct"), _deal("declaration")
