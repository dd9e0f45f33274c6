"""Dangerous Python code: facts from the syntax tree, rules as Spark expressions.

Reading Python syntax is the only step that needs a Python worker. One Arrow UDF turns a text
into a small struct of facts (calls, imports, comments, errors); everything that decides what
a fact means is a Column expression on that struct, so rules run in the JVM and per-text
summaries need no shuffle.
"""

from __future__ import annotations

import ast
import gc
import io
import re
import tokenize
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from veilscan.functions.matching import first_of, let
from veilscan.model import finding

# The names the rules look for.
DANGEROUS_CALLS = ["eval", "exec", "compile", "__import__"]
DECODERS = [
    "b64decode", "b16decode", "b32decode", "a85decode",
    "decompress", "loads", "unhexlify", "decode",
]
SENSITIVE_IMPORTS = [
    "socket", "subprocess", "ctypes", "marshal", "pickle", "telnetlib",
    "ftplib", "paramiko", "requests", "urllib", "http", "httpx",
    "aiohttp", "urllib3", "websocket", "websockets", "pty", "shutil",
]
NETWORK_MODULES = [
    "requests", "urllib", "httpx", "aiohttp", "http", "urllib3",
    "ftplib", "telnetlib", "socket", "websocket", "websockets",
]
NETWORK_CALLS = ["urlopen", "create_connection"]
OS_SHELL_CALLS = ["system", "popen"]
SHELL_RUNNERS = ["run", "call", "Popen", "check_output", "check_call"]
# Lengths of the listings in a finding.
SNIPPET_SHOWN = 120
LABELS_SHOWN = 6
LINES_SHOWN = 10
# Of texts whose facts a worker holds at once.
FACTS_CHARS = 1 << 18
FACTS_TEXTS = 1_000

CALL_TYPE = (
    "struct<line:int,name:string,root:string,label:string,bare:boolean,nonliteral:boolean,"
    "decoder:boolean,shell:boolean,snippet:string>"
)
IMPORT_TYPE = "struct<line:int,root:string>"
COMMENT_TYPE = "struct<line:int,text:string>"
FACTS_TYPE = (
    f"struct<calls:array<{CALL_TYPE}>,imports:array<{IMPORT_TYPE}>,"
    f"comments:array<{COMMENT_TYPE}>,syntax_line:int,syntax_error:string,failure:string>"
)

_CALL = pa.struct(
    [
        ("line", pa.int32()),
        ("name", pa.string()),
        ("root", pa.string()),
        ("label", pa.string()),
        ("bare", pa.bool_()),
        ("nonliteral", pa.bool_()),
        ("decoder", pa.bool_()),
        ("shell", pa.bool_()),
        ("snippet", pa.string()),
    ]
)
_FACTS = pa.struct(
    [
        ("calls", pa.list_(_CALL)),
        ("imports", pa.list_(pa.struct([("line", pa.int32()), ("root", pa.string())]))),
        ("comments", pa.list_(pa.struct([("line", pa.int32()), ("text", pa.string())]))),
        ("syntax_line", pa.int32()),
        ("syntax_error", pa.string()),
        ("failure", pa.string()),
    ]
)

# Only calls that some rule can report leave the worker.
_WATCHED_NAMES = frozenset(DANGEROUS_CALLS + NETWORK_CALLS + OS_SHELL_CALLS + SHELL_RUNNERS)
_WATCHED_ROOTS = frozenset(NETWORK_MODULES)
# A text in plain ASCII without any of these words has no fact to report besides its errors
# and comments. (Identifiers in other alphabets may be normalized to one of the names.)
_WATCHED_WORDS = re.compile(
    rf"\b(?:{'|'.join(sorted({*_WATCHED_NAMES, *_WATCHED_ROOTS, *SENSITIVE_IMPORTS}))})\b"
)
# Nodes that cannot contain a call or an import, and fields that hold none but such.
_LEAVES = (ast.Name, ast.Constant, ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop, ast.alias)
_LEAF_FIELDS = frozenset({"id", "attr", "arg", "name", "asname", "ctx", "op", "ops", "module", "level", "type_comment"})
_KINDS = [k for k in vars(ast).values() if isinstance(k, type) and issubclass(k, ast.AST)]
_INNER = frozenset(k for k in _KINDS if not issubclass(k, _LEAVES))
_INNER_FIELDS = {k: tuple(f for f in k._fields if f not in _LEAF_FIELDS) for k in _KINDS}


def _printable(text: str) -> str:
    """Text that survives the trip to the JVM (string escapes may yield lone surrogates)."""
    return text.encode("utf-8", "replace").decode("utf-8")


def _chain(func: ast.expr) -> tuple[str, list[str]]:
    """Last name of a called expression and, for plain `a.b.c` chains, all its names."""
    if type(func) is ast.Name:
        return func.id, [func.id]
    names = []
    while isinstance(func, ast.Attribute):
        names.insert(0, func.attr)
        func = func.value
    if isinstance(func, ast.Name):
        names.insert(0, func.id)
        return names[-1], names
    return (names[-1] if names else ""), []


def _call_fact(call: ast.Call) -> dict | None:
    name, chain = _chain(call.func)
    root = chain[0] if chain else ""
    if name not in _WATCHED_NAMES and root not in _WATCHED_ROOTS:
        return None
    # Of repeated keywords the first with a constant counts.
    shell = call.keywords and [k.value for k in call.keywords if k.arg == "shell" and isinstance(k.value, ast.Constant)]
    fact = {
        "line": call.lineno,
        "name": name,
        "root": root,
        "label": ".".join(chain) or name,
        "bare": len(chain) == 1,
        "nonliteral": not all(isinstance(arg, ast.Constant) for arg in call.args),
        "shell": bool(shell and shell[0].value),
    }
    if fact["bare"] and name in DANGEROUS_CALLS:
        if not call.keywords and all(type(arg) is ast.Name for arg in call.args):
            # What unparse would write, without a look at the parts.
            fact["decoder"] = name in DECODERS
            fact["snippet"] = _printable(f"{name}({', '.join([arg.id for arg in call.args])})")
            return fact
        inner = (n for n in ast.walk(call) if isinstance(n, ast.Call))
        fact["decoder"] = any(_chain(n.func)[0] in DECODERS for n in inner)
        try:
            fact["snippet"] = _printable(ast.unparse(call))
        except Exception:
            fact["snippet"] = None
    return fact


def _inner_nodes(node: ast.AST) -> list[ast.AST]:
    found = []
    for name in _INNER_FIELDS[type(node)]:
        value = getattr(node, name, None)
        if type(value) is list:
            found += [n for n in value if type(n) in _INNER]
        elif type(value) in _INNER:
            found.append(value)
    return found


def _tree_facts(text: str) -> dict:
    """Facts of the syntax tree; whatever goes wrong with a text is a fact about it."""
    try:
        return _parsed_facts(text, ast.parse(text))
    except SyntaxError as error:
        return {"syntax_line": error.lineno, "syntax_error": _printable(str(error.msg))}
    except Exception as error:
        return {"failure": _printable(f"{type(error).__name__}: {error}")}


def _parsed_facts(text: str, tree: ast.AST) -> dict:
    if text.isascii() and not _WATCHED_WORDS.search(text):
        return {}
    calls, roots, pending = [], [], [tree]
    while pending:  # source order, without recursion on deeply nested code
        node = pending.pop()
        kind = type(node)
        if kind is ast.Call:
            calls.append(_call_fact(node))
        elif kind is ast.Import:
            roots += [(node.lineno, alias.name.partition(".")[0]) for alias in node.names]
            continue
        elif kind is ast.ImportFrom:
            if node.module:
                roots.append((node.lineno, node.module.partition(".")[0]))
            continue
        pending += reversed(_inner_nodes(node))
    return {
        "calls": [c for c in calls if c],
        "imports": [{"line": line, "root": r} for line, r in roots if r in SENSITIVE_IMPORTS],
    }


def _comments(text: str) -> list[dict]:
    """Comments of a text; none at all when it does not tokenize to its end."""
    try:
        return [
            {"line": token.start[0], "text": token.string}
            for token in tokenize.generate_tokens(io.StringIO(text).readline)
            if token.type == tokenize.COMMENT
        ]
    except Exception:
        return []


@contextmanager
def _no_collection() -> Iterator[None]:
    """Syntax trees hold no cycles; the collector would walk all their nodes again and again."""
    was_on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was_on:
            gc.enable()


def text_facts(text: str, with_comments: bool) -> dict:
    """Facts about one text; warnings that a source gives rise to are the caller's to catch."""
    comments = _comments(text) if with_comments and "#" in text else []
    return {"calls": [], "imports": [], "comments": comments, **_tree_facts(text)}


def _few(texts: pa.Array, with_comments: pa.Array) -> Iterator[list[tuple[str | None, bool]]]:
    """The texts of a batch, a few at a time: facts take many times the bytes of their text."""
    held, n_chars = [], 0
    for text, wanted in zip(texts, with_comments):
        held.append((text.as_py(), wanted.as_py()))
        n_chars += len(held[-1][0] or "")
        if n_chars >= FACTS_CHARS or len(held) == FACTS_TEXTS:
            yield held
            held, n_chars = [], 0
    if held:
        yield held


def _facts_array(texts: list[tuple[str | None, bool]]) -> pa.Array:
    with warnings.catch_warnings(), _no_collection():  # sources may warn about their own escapes
        warnings.simplefilter("ignore")
        return pa.array([None if t is None else text_facts(t, wanted) for t, wanted in texts], type=_FACTS)


def _facts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for batch in batches:
        yield from map(_facts_array, _few(*batch))


def code_facts(text: Column, with_comments: Column | None = None) -> Column:
    """Facts about a text read as Python; `with_comments` may skip tokenizing per row."""
    wanted = F.lit(True) if with_comments is None else with_comments
    return F.arrow_udf(_facts, FACTS_TYPE, ArrowUDFType.SCALAR_ITER)(text, F.coalesce(wanted, F.lit(False)))


def is_network(call: Column) -> Column:
    """Network access, told by the module or a distinctive function, never by a method name."""
    return call.getField("name").isin(NETWORK_CALLS) | call.root.isin(NETWORK_MODULES)


def is_shell(call: Column) -> Column:
    """A command run by `os`, or any runner called with a true constant `shell`."""
    name = call.getField("name")
    return (name.isin(OS_SHELL_CALLS) & (call.root == "os")) | (
        name.isin(SHELL_RUNNERS) & call.shell
    )


def is_dangerous(call: Column) -> Column:
    """A bare call of a code-running builtin; `re.compile` and the like are not bare."""
    return call.bare & call.getField("name").isin(DANGEROUS_CALLS)


def exec_findings(facts: Column) -> Column:
    """Graded calls of eval, exec, compile and __import__, in source order."""

    def graded(call: Column) -> Column:
        def choose(decoded: str, dynamic: str, literal: str) -> Column:
            return F.when(call.decoder, decoded).when(call.nonliteral, dynamic).otherwise(literal)

        shown = F.when(
            F.length(call.snippet) > SNIPPET_SHOWN,
            F.concat(F.left(call.snippet, F.lit(SNIPPET_SHOWN)), F.lit("…")),
        ).otherwise(call.snippet)
        return finding(
            "dangerous_exec",
            choose("critical", "high", "medium"),
            choose("finding.exec_decoded", "finding.exec_dynamic", "finding.exec_literal"),
            line=call.line,
            detail=F.coalesce(shown, F.lit("<...>")),
            rec_key="rec.dangerous_exec",
            call=call.getField("name"),
            snippet=call.snippet,
        )

    return F.transform(F.filter(facts.calls, is_dangerous), graded)


def import_findings(facts: Column) -> Column:
    """First import of each sensitive module, by line."""
    roots = F.array_distinct(F.transform(facts.imports, lambda x: x.root))
    firsts = F.transform(
        roots,
        lambda root: F.get(F.filter(facts.imports, lambda x: x.root == root), F.lit(0)),
    )
    return F.transform(
        F.filter(firsts, lambda x: x.root.isin(SENSITIVE_IMPORTS)),
        lambda x: finding(
            "sensitive_import",
            "info",
            "finding.sensitive_import",
            line=x.line,
            detail=x.root,
            rec_key="rec.sensitive_import",
            module=x.root,
        ),
    )


def _summary(calls: Column, kind: str, severity: str, title: str, suffix: str) -> Column:
    """All given calls of a text as at most one finding."""

    def summed(lines: Column, labels: Column) -> Column:
        return finding(
            kind,
            severity,
            title,
            line=F.get(lines, F.lit(0)),
            detail=F.concat(
                F.lit("×"),
                F.size(calls).cast("string"),
                F.lit(" · "),
                first_of(labels, LABELS_SHOWN),
                F.lit(" · @ "),
                first_of(lines, LINES_SHOWN),
            ),
            rec_key=f"rec.{kind}",
            count=F.size(calls),
            lines=lines,
            labels=labels,
        )

    lines = F.array_sort(F.array_distinct(F.transform(calls, lambda c: c.line)))
    labels = F.array_sort(
        F.array_distinct(F.transform(calls, lambda c: F.concat(c.label, F.lit(suffix))))
    )
    one = let(lines, lambda ls: let(labels, lambda lb: summed(ls, lb)))
    return F.filter(F.array(F.when(F.size(calls) > 0, one)), lambda f: f.isNotNull())


def network_findings(facts: Column) -> Column:
    return let(
        F.filter(facts.calls, is_network),
        lambda calls: _summary(calls, "network_call", "info", "finding.network_calls", ""),
    )


def shell_findings(facts: Column) -> Column:
    return let(
        F.filter(facts.calls, is_shell),
        lambda calls: _summary(calls, "shell_exec", "medium", "finding.shell_execs", "(...)"),
    )


def error_findings(facts: Column) -> Column:
    """A text that does not parse, or a failure of the analysis itself."""
    syntax = finding(
        "parse_error",
        "low",
        "finding.parse_error",
        line=facts.syntax_line,
        detail=facts.syntax_error,
        rec_key="rec.parse_error",
    )
    failure = finding(
        "detector_error",
        "info",
        "finding.detector_error",
        detail=F.concat(F.lit("python code: "), facts.failure),
    )
    one = F.when(facts.syntax_error.isNotNull(), syntax).when(facts.failure.isNotNull(), failure)
    return F.filter(F.array(one), lambda f: f.isNotNull())


def code_findings(facts: Column) -> Column:
    """All findings of the code rules, in report order."""
    return F.concat(
        exec_findings(facts),
        import_findings(facts),
        network_findings(facts),
        shell_findings(facts),
        error_findings(facts),
    )
