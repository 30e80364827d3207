"""Source text to symbols and imports: Python by the standard library's parser, the others by scanning declarations.

``parse`` never raises for a file's syntax; errors make a row with success false. A language is added with ``register``.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Symbol:
    name: str
    symbol_type: str
    start_line: int
    end_line: int
    parent: str | None = None
    docstring: str | None = None
    signature: str | None = None
    modifiers: list[str] = field(default_factory=list)
    parameters: list[str] = field(default_factory=list)
    return_type: str | None = None
    body: str | None = None


@dataclass
class Import:
    module: str
    names: list[str]
    line: int
    alias: str | None = None
    is_relative: bool = False


_NAMES = {kind: tuple(f.name for f in fields(kind)) for kind in (Symbol, Import)}
Parsed = tuple[list[Symbol], list[Import], list[str]]
SYMBOL = "struct<name string, symbol_type string, start_line int, end_line int, parent string, docstring string, signature string, modifiers array<string>, parameters array<string>, return_type string, body string>"
IMPORT = "struct<module string, names array<string>, line int, alias string, is_relative boolean>"
SCHEMA = f"path string, language string, success boolean, errors array<string>, symbols array<{SYMBOL}>, imports array<{IMPORT}>"

#: The same for Arrow.
_TEXT, _TEXTS = pa.string(), pa.list_(pa.string())
_SYMBOL = pa.struct([("name", _TEXT), ("symbol_type", _TEXT), ("start_line", pa.int32()), ("end_line", pa.int32()), ("parent", _TEXT), ("docstring", _TEXT), ("signature", _TEXT), ("modifiers", _TEXTS), ("parameters", _TEXTS), ("return_type", _TEXT), ("body", _TEXT)])
_IMPORT = pa.struct([("module", _TEXT), ("names", _TEXTS), ("line", pa.int32()), ("alias", _TEXT), ("is_relative", pa.bool_())])
ARROW = pa.schema([("path", _TEXT), ("language", _TEXT), ("success", pa.bool_()), ("errors", _TEXTS), ("symbols", pa.list_(_SYMBOL)), ("imports", pa.list_(_IMPORT))])


def _python(text: str) -> Parsed:
    lines, symbols, imports = text.split("\n"), [], []

    def visit(node: ast.AST, owner: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            here = owner
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                is_class = isinstance(child, ast.ClassDef)
                marks = [f"@{ast.unparse(d)}" for d in child.decorator_list] + ["async"] * isinstance(child, ast.AsyncFunctionDef)
                arguments = [] if is_class else [ast.unparse(a) for a in (*child.args.posonlyargs, *child.args.args, *([child.args.vararg] if child.args.vararg else []), *child.args.kwonlyargs, *([child.args.kwarg] if child.args.kwarg else []))]
                returns = None if is_class or child.returns is None else ast.unparse(child.returns)
                kind = "class" if is_class else "method" if owner else "function"
                symbols.append(Symbol(child.name, kind, child.lineno, child.end_lineno, owner, ast.get_docstring(child), lines[child.lineno - 1].strip(), marks, arguments, returns, "\n".join(lines[child.lineno - 1 : child.end_lineno])))
                here = child.name if is_class else None
            elif isinstance(child, ast.Import):
                imports.extend(Import(a.name, [], child.lineno, a.asname) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                imports.append(Import("." * child.level + (child.module or ""), [a.name for a in child.names], child.lineno, next((a.asname for a in child.names if a.asname), None), child.level > 0))
            visit(child, here)

    visit(ast.parse(text), None)
    return symbols, imports, []


def _blank(text: str, strings: str) -> str:
    """The text with comments and the insides of strings as spaces, so that braces and words in them don't count."""
    pattern = re.compile(r"//[^\n]*|/\*.*?\*/|" + strings, re.DOTALL)

    def blank(m: re.Match) -> str:
        keep = m[0][0] if m[0][0] in "\"'`" else ""
        inner = re.sub(r"[^\n]", " ", m[0])
        return keep + inner[1:-1] + keep if keep else inner

    return pattern.sub(blank, text)


def _end_of_block(code: str, at: int) -> int:
    """Where the block ends whose opening brace comes next, or the end of the line if none comes before one."""
    stop, opening = code.find(";", at), code.find("{", at)
    if opening < 0 or 0 <= stop < opening:
        line = code.find("\n", at)
        return len(code) - 1 if line < 0 else line
    depth = 0
    for i in range(opening, len(code)):
        depth += (code[i] == "{") - (code[i] == "}")
        if depth == 0:
            return i
    return -1


class _Braced:
    """Scans declarations of a language with braces: each rule is a kind and a pattern with the group ``name``."""

    strings = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`'
    rules: tuple[tuple[str, str], ...] = ()
    owners = ("class", "interface", "enum")
    keywords = frozenset("if for while switch catch return new else do try synchronized function super throw await typeof".split())

    def __call__(self, text: str) -> Parsed:
        code, lines, errors = _blank(text, self.strings), text.split("\n"), []
        found: list[tuple[int, int, Symbol]] = []
        for kind, pattern in self.rules:
            for m in re.finditer(pattern, code, re.MULTILINE):
                if m["name"] in self.keywords or any(a == m.start("name") for a, _, _ in found):
                    continue
                end = _end_of_block(code, m.end())
                if end < 0:
                    errors.append(f"line {code.count(chr(10), 0, m.start('name')) + 1}: block without end")
                    end = len(code) - 1
                first, last = (code.count("\n", 0, i) + 1 for i in (m.start("name"), end))
                got = m.groupdict()
                arguments = [x.strip() for x in (got.get("arguments") or "").split(",") if x.strip()]
                found.append((m.start("name"), end, Symbol(m["name"], kind, first, last, got.get("owner"), None, lines[first - 1].strip(), (got.get("marks") or "").split(), arguments, (got.get("returns") or "").strip() or None, "\n".join(lines[first - 1 : last]))))
        found.sort(key=lambda x: x[0])
        symbols = []
        for start, end, s in found:
            around = [o for a, b, o in found if a < start and end <= b and o.symbol_type in self.owners]
            if s.parent is None and around:
                s.parent = around[-1].name
            if s.symbol_type == "method" and s.parent is None:
                continue  # calls and blocks outside of a class
            symbols.append(s)
        if code.count("{") != code.count("}"):
            errors.append("braces don't match")
        return symbols, list(self.imports(text, code)), errors

    def imports(self, text: str, code: str) -> Iterator[Import]:
        return iter(())


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


class _Go(_Braced):
    rules = (
        ("class", r"^\s*type\s+(?P<name>\w+)\s+struct\b"),
        ("interface", r"^\s*type\s+(?P<name>\w+)\s+interface\b"),
        ("constant", r"^\s*type\s+(?P<name>\w+)\s+(?!struct\b|interface\b)\S"),
        ("method", r"^func\s*\(\s*(?:\w+\s+)?\*?(?P<owner>\w+)(?:\[[^\]]*\])?\s*\)\s*(?P<name>\w+)\s*\((?P<arguments>[^)]*)\)(?P<returns>[^{\n]*)"),
        ("function", r"^func\s+(?P<name>\w+)(?:\[[^\]]*\])?\s*\((?P<arguments>[^)]*)\)(?P<returns>[^{\n]*)"),
    )

    def imports(self, text: str, code: str) -> Iterator[Import]:
        for block in re.finditer(r'^import\s*(?:\((.*?)\)|((?:[\w.]+\s+)?"[^"]*"))', text, re.MULTILINE | re.DOTALL):
            inner = block[1] if block[1] is not None else block[2]
            for m in re.finditer(r'(?:([\w.]+)[ \t]+)?"([^"]+)"', inner):
                yield Import(m[2], [], _line(text, block.start(1 if block[1] is not None else 2) + m.start()), m[1], m[2].startswith("."))


_JAVA_MARKS = r"(?P<marks>(?:(?:@\w+(?:\([^)]*\))?|public|protected|private|static|final|abstract|synchronized|default|native|sealed)\s+)*)"


class _Java(_Braced):
    strings = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
    rules = (
        ("class", rf"^\s*{_JAVA_MARKS}(?:class|record)\s+(?P<name>\w+)"),
        ("interface", rf"^\s*{_JAVA_MARKS}@?interface\s+(?P<name>\w+)"),
        ("enum", rf"^\s*{_JAVA_MARKS}enum\s+(?P<name>\w+)"),
        ("method", rf"^\s*{_JAVA_MARKS}(?:<[^>]+>\s*)?(?P<returns>[\w.<>,\[\]? ]+?)\s+(?P<name>\w+)\s*\((?P<arguments>[^)]*)\)\s*(?:throws\s+[\w., ]+)?(?=[{{;])"),
        ("method", rf"^\s*{_JAVA_MARKS}(?P<name>[A-Z]\w*)\s*\((?P<arguments>[^)]*)\)\s*(?:throws\s+[\w., ]+)?(?={{)"),
    )

    def imports(self, text: str, code: str) -> Iterator[Import]:
        for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+?)(\.\*)?\s*;", code, re.MULTILINE):
            yield Import(m[1], ["*"] if m[2] else [m[1].rpartition(".")[2]], _line(code, m.start(1)))


class _JavaScript(_Braced):
    rules = (
        ("class", r"^\s*(?P<marks>(?:(?:export|default|abstract)\s+)*)class\s+(?P<name>\w+)"),
        ("function", r"^\s*(?P<marks>(?:(?:export|default|async)\s+)*)function\s*\*?\s*(?P<name>\w+)\s*(?:<[^>]*>)?\((?P<arguments>[^)]*)\)(?:\s*:\s*(?P<returns>[^{\n]+))?"),
        ("function", r"^\s*(?P<marks>(?:export\s+)?(?:const|let|var)\s+)(?P<name>\w+)\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:function\b\s*\w*\s*)?\((?P<arguments>[^)]*)\)(?:\s*:\s*(?P<returns>[^={\n]+?))?\s*(?:=>|(?=\{))"),
        ("method", r"^\s*(?P<marks>(?:(?:public|private|protected|static|readonly|abstract|override|async|get|set)\s+)*)(?P<name>#?\w+)\s*(?:<[^>]*>)?\((?P<arguments>[^)]*)\)(?:\s*:\s*(?P<returns>[^{\n]+))?\s*(?=\{)"),
    )

    def imports(self, text: str, code: str) -> Iterator[Import]:
        for m in re.finditer(r"""^\s*import\s+(?:(?P<what>[^'"]*?)\s+from\s+)?['"](?P<module>[^'"]+)['"]""", text, re.MULTILINE):
            names = [x.strip() for x in re.sub(r"[{}]|\btype\b", " ", m["what"] or "").split(",") if x.strip()]
            alias = next((x.partition(" as ")[2].strip() for x in names if " as " in x), None)
            yield Import(m["module"], [x.partition(" as ")[0].strip() for x in names], _line(text, m.start("module")), alias, m["module"].startswith("."))
        for m in re.finditer(r"""\b(?:const|let|var)\s+(?P<what>[^=;]+?)\s*=\s*require\(\s*['"](?P<module>[^'"]+)['"]\s*\)""", text):
            yield Import(m["module"], [x.strip() for x in re.sub(r"[{}]", " ", m["what"]).split(",") if x.strip()], _line(text, m.start()), None, m["module"].startswith("."))


class _TypeScript(_JavaScript):
    rules = (
        ("interface", r"^\s*(?P<marks>(?:(?:export|default|declare)\s+)*)interface\s+(?P<name>\w+)"),
        ("enum", r"^\s*(?P<marks>(?:(?:export|declare|const)\s+)*)enum\s+(?P<name>\w+)"),
        ("constant", r"^\s*(?P<marks>(?:(?:export|declare)\s+)*)type\s+(?P<name>\w+)\s*(?:<[^>]*>)?\s*="),
        *_JavaScript.rules,
    )


_languages: dict[str, tuple[str, Callable[[str], Parsed]]] = {}


def register(language: str, suffixes: tuple[str, ...], parser: Callable[[str], Parsed]) -> None:
    _languages.update((s, (language, parser)) for s in suffixes)


register("python", ("py", "pyi"), _python)
register("go", ("go",), _Go())
register("java", ("java",), _Java())
register("javascript", ("js", "jsx", "mjs", "cjs"), _JavaScript())
register("typescript", ("ts", "tsx"), _TypeScript())


def _row(of: Symbol | Import) -> dict:
    """A new dictionary with the object's own values: what vars() gives may lose lists once its object is gone, and asdict copies every list."""
    return {name: getattr(of, name) for name in _NAMES[type(of)]}


def parse(path: str, content: bytes) -> dict:
    """One file as a row of SCHEMA."""
    language, parser = _languages.get(path.rpartition(".")[2].lower(), ("unknown", None))
    row = {"path": path, "language": language, "success": False, "errors": [], "symbols": [], "imports": []}
    try:
        if parser is None:
            raise ValueError("no parser for this suffix")
        if b"\x00" in content[:8192]:
            raise ValueError("binary file")
        symbols, imports, row["errors"] = parser(content.decode("utf-8"))
        row["symbols"], row["imports"] = [_row(s) for s in symbols], [_row(i) for i in imports]
        row["success"] = not row["errors"]
    except (SyntaxError, ValueError, RecursionError) as e:
        row["errors"] = [f"{type(e).__name__}: {e}"]
    return row


def parse_tree(tree: DataFrame) -> DataFrame:
    """tree: (path, content). A row per file; files are dealt over tasks by Spark's file splits."""

    def run(batches):
        for batch in batches:
            rows = [parse(p, c) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return tree.select("path", "content").mapInArrow(run, SCHEMA)


def symbols_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", "language", F.explode("symbols").alias("s")).select("path", "language", "s.*")


def imports_of(parsed: DataFrame) -> DataFrame:
    """Imports with the candidate paths of their module, in order of preference."""
    flat = parsed.select("path", "language", F.explode("imports").alias("i")).select(F.col("path").alias("src"), "language", "i.*")
    folder = F.when(F.contains("src", F.lit("/")), F.regexp_replace("src", "/[^/]*$", "")).otherwise("")
    dots = F.length("module") - F.length(F.regexp_replace("module", r"^\.+", ""))
    up = F.split(folder, "/")
    base = F.array_join(F.slice(up, F.lit(1), F.greatest(F.size(up) - F.greatest(dots - 1, F.lit(0)), F.lit(0))), "/")
    dotted = F.translate(F.regexp_replace("module", r"^\.+", ""), ".", "/")
    python = F.when(dots > 0, F.concat_ws("/", F.nullif(base, F.lit("")), F.nullif(dotted, F.lit("")))).otherwise(dotted)
    script = F.regexp_replace(F.concat_ws("/", F.nullif(folder, F.lit("")), F.regexp_replace("module", r"^(\./)+", "")), r"[^/]+/\.\./", "")
    stem = F.when(F.col("language") == "python", python).when(F.col("is_relative"), script).otherwise(F.translate("module", ".", "/"))
    endings = F.when(F.col("language") == "python", F.array(*map(F.lit, (".py", "/__init__.py")))).when(F.col("language") == "java", F.array(F.lit(".java"))).otherwise(F.array(*map(F.lit, ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js"))))
    return flat.select("src", "module", "is_relative", F.transform(endings, lambda e: F.concat(stem, e)).alias("candidates"))
