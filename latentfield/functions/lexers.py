"""Lexers of source text (LEX*): what names a file uses, defines and imports.

The language-free lexer is a chain of SQL expressions. The others are Python, run once for each file
inside a table function: JavaScript and TypeScript by an own scanner, Python by the standard library, the
remaining languages by one table-driven scanner. All give up gracefully: a file that can't be lexed is taken as plain text.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scalars import split_parts, tokens_of, word_tokens

#: Words of many languages that say nothing about what code does; fixed list.
GENERIC_KEYWORDS = (
    "export", "import", "function", "func", "def", "return", "const", "let",
    "var", "class", "struct", "interface", "type", "enum", "trait", "impl",
    "public", "private", "protected", "static", "final", "void", "null", "nil",
    "none", "true", "false", "if", "else", "elif", "for", "while", "switch",
    "case", "break", "continue", "new", "this", "self", "super", "async", "await",
    "yield", "throw", "throws", "try", "catch", "finally", "package", "namespace",
    "using", "include", "module", "from", "as", "in", "is", "and", "or", "not",
    "end", "begin", "then", "do", "lambda", "pass", "raise", "with", "where",
)
#: Extension -> lexer, fixed by the extensions that are scanned.
SCRIPT = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
LANGUAGES = {".py": "python", ".go": "go", ".rb": "ruby", ".java": "java", ".rs": "rust", ".php": "php", ".cs": "c_sharp"}

#: LEX1: what is blanked, in this order, and what a text must hold for it. Possessive repeats, so that long literals need no stack.
BLANKED = (
    ("/*", r"/\*(?s:.*?)\*/"),
    ('"', r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'),
    ("'", r"'[^'\\]*+(?:\\.[^'\\]*+)*+'"),
    ("`", r"`[^`\\]*+(?:\\.[^`\\]*+)*+`"),
    ("//", r"//[^\n]*"),
    ("#", r"#[^\n]*"),
)
STRIPPED = tuple(pattern for _, pattern in BLANKED)


def stripped(text: Column) -> Column:
    """A pattern is tried on texts alone that hold its mark: a space in place of what went before never makes a mark."""
    steps = F.array(*(F.struct(F.lit(mark).alias("mark"), F.lit(pattern).alias("pattern")) for mark, pattern in BLANKED))
    return F.aggregate(steps, text, lambda t, s: F.when(F.contains(text, s["mark"]), F.regexp_replace(t, s["pattern"], F.lit(" "))).otherwise(t))


def text_identifiers(text: Column) -> Column:
    """LEX1: distinct identifiers of any language's text."""
    found = F.array_distinct(F.regexp_extract_all(stripped(text), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))
    return F.filter(found, lambda x: ~F.lower(x).isin(*GENERIC_KEYWORDS))


def match_tokens(files: DataFrame, identifiers: Column, *, by: tuple[str, ...] = ()) -> DataFrame:
    """(path, space, token) rows of files, for matching signals; no shuffle. Columns named by `by` come along.

    Identifiers become rows before they are split, so that each is split once; one that is a word, as most are, isn't split. Two
    identifiers of a file may give one token twice, which matching does away with.
    """
    ids = files.select(*by, "path", F.explode(identifiers).alias("id"))
    # no filter on parts, which would be pushed below this and split each identifier once more
    parts = ids.select(*by, "path", F.lower("id").alias("full"), split_parts(F.col("id")).alias("parts"))
    none = F.expr("array()").cast("array<struct<space:string,token:string>>")
    split = F.when(F.size("parts") > 0, tokens_of(F.col("full"), F.col("parts"))).when(F.col("parts").isNotNull(), none)
    # apart from explode(), which Spark runs in generated code only if it holds no lambda
    made = parts.select(*by, "path", "full", split.alias("split"))
    return made.select(*by, "path", F.explode(F.coalesce("split", word_tokens(F.col("full")))).alias("t")).select(*by, "path", "t.space", "t.token")


def text_tokens(files: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """match_tokens() of (path, text) by LEX1."""
    return match_tokens(files, text_identifiers(F.col("text")), by=by)


# JavaScript and TypeScript

RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with"
    " implements interface let package private protected public static yield async await".split()
)
TYPE_WORDS = frozenset("any boolean number string symbol object unknown never bigint".split())
CONTEXTUAL = frozenset("type of from as readonly declare abstract namespace module keyof infer is asserts satisfies get set global override".split())
NAME = re.compile(r"[A-Za-z_$\u0080-￿][\w$\u0080-￿]*")
NUMBER = re.compile(r"(?:0[xXbBoO][0-9a-fA-F_]+|[0-9][0-9_]*(?:\.[0-9_]*)?(?:[eE][+-]?[0-9]+)?)n?")
BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())


def script_scan(text: str) -> list[tuple[str, str, bool]]:
    """Tokens (kind, value, after a line end): name, string, number, regex or mark. Templates give what their ${} hold."""
    out: list[tuple[str, str, bool]] = []
    i, n, fresh = 0, len(text), True
    templates: list[int] = []  # depth of braces at each open ${
    depth = 0

    def template(at: int) -> int:
        """Past a template's text from at, up to its end or its next ${."""
        nonlocal depth
        while at < n:
            c = text[at]
            if c == "\\":
                at += 2
            elif c == "`":
                return at + 1
            elif text.startswith("${", at):
                templates.append(depth)
                depth += 1
                return at + 2
            else:
                at += 1
        return n

    while i < n:
        c = text[i]
        if c in " \t\r\n\f\v﻿":
            fresh |= c == "\n"
            i += 1
            continue
        if text.startswith("//", i) or (i == 0 and text.startswith("#!")):
            j = text.find("\n", i)
            i = n if j < 0 else j
            continue
        if text.startswith("/*", i):
            j = text.find("*/", i + 2)
            fresh |= "\n" in text[i : n if j < 0 else j]
            i = n if j < 0 else j + 2
            continue
        if c in "\"'":
            j = i + 1
            while j < n and text[j] != c and text[j] != "\n":
                j += 2 if text[j] == "\\" else 1
            out.append(("string", text[i + 1 : j], fresh))
            i, fresh = j + 1, False
            continue
        if c == "`":
            out.append(("template", "", fresh))
            i, fresh = template(i + 1), False
            continue
        if c == "}" and templates and depth == templates[-1] + 1:
            depth = templates.pop()
            i = template(i + 1)
            continue
        if m := NUMBER.match(text, i) if c.isdigit() else None:
            out.append(("number", m[0], fresh))
            i, fresh = m.end(), False
            continue
        if m := NAME.match(text, i + (c == "#")):
            out.append(("name", m[0], fresh))
            i, fresh = m.end(), False
            continue
        if c == "/":
            last = out[-1] if out else ("mark", "(", True)
            if last[0] == "mark" and last[1] not in (")", "]", "}") or last[0] == "name" and last[1] in BEFORE_REGEX:
                j, inside = i + 1, False
                while j < n and text[j] != "\n" and (inside or text[j] != "/"):
                    inside = text[j] == "[" or inside and text[j] != "]"
                    j += 2 if text[j] == "\\" else 1
                m = NAME.match(text, j + 1)
                out.append(("regex", text[i : j + 1], fresh))
                i, fresh = m.end() if m else j + 1, False
                continue
        depth += (c == "{") - (c == "}")
        out.append(("mark", "=>" if text.startswith("=>", i) else "..." if text.startswith("...", i) else c, fresh))
        i, fresh = i + len(out[-1][1]), False
    return out


def is_identifier(tokens: list[tuple[str, str, bool]], k: int) -> bool:
    """Whether a name is an identifier where it stands: keywords are, as properties; contextual ones, unless they lead another name."""
    kind, value, _ = tokens[k]
    if kind != "name":
        return False
    before = tokens[k - 1][1] if k and tokens[k - 1][0] == "mark" else ""
    after = tokens[k + 1] if k + 1 < len(tokens) else ("mark", "", True)
    if before == "." or after[1] == ":" and value not in ("case", "default") and before in ("{", ",", ";", "(", ""):
        return True
    if value in RESERVED:
        return False
    if value in TYPE_WORDS:
        return before not in (":", "|", "&", "<", "=>", "=", ",", "(", "[") and after[0] == "mark" and after[1] in ("=", "(", ".")
    if value in CONTEXTUAL:
        return not (after[0] in ("name", "string") or after[1] in ("{", "*") and value in ("from", "type", "of", "as"))
    return True


def script_identifiers(text: str, scanned: list[tuple[str, str, bool]] | None = None) -> list[str]:
    """LEX2. scanned: script_scan(text), if it is there already; also below."""
    t = script_scan(text) if scanned is None else scanned
    return list(dict.fromkeys(v for k, (_, v, _) in enumerate(t) if is_identifier(t, k)))


OPEN, CLOSE = {"(": 1, "[": 1, "{": 1}, {")": 1, "]": 1, "}": 1}
CONTINUES = frozenset("+ - * / % & | ^ ? : . = < > , ( [ { => && || ! ~".split())


def closing(tokens: list[tuple[str, str, bool]], k: int) -> int:
    """Index of the mark that closes the bracket at k."""
    depth = 0
    for j in range(k, len(tokens)):
        if tokens[j][0] == "mark":
            depth += tokens[j][1] in OPEN
            depth -= tokens[j][1] in CLOSE
            if depth == 0:
                return j
    return len(tokens) - 1


def body_end(tokens: list[tuple[str, str, bool]], k: int) -> int:
    """End of a function, class, interface or enum from k: of its first braces, or of the statement if it has none."""
    j = k
    while j < len(tokens):
        kind, value, _ = tokens[j]
        if kind == "mark":
            if value == "{" and not (tokens[j - 1][1] in (":", "|", "&") and tokens[j - 1][0] == "mark"):
                return closing(tokens, j)
            if value in OPEN:
                j = closing(tokens, j)
            elif value == ";":
                return j
        j += 1
    return len(tokens) - 1


def value_end(tokens: list[tuple[str, str, bool]], k: int, of_type: bool = False) -> int:
    """End of a variable's or type's declaration from its name at k. In types, < and > are brackets."""
    j, angle, in_type = k + 1, 0, of_type
    while j < len(tokens):
        kind, value, fresh = tokens[j]
        last = tokens[j - 1]
        if kind == "mark" and not of_type:
            in_type = value == ":" and j == k + 1 or in_type and value != "="
        if kind == "mark" and in_type and value in "<>":
            angle = max(0, angle + (1 if value == "<" else -1))
        if angle:
            j += 1
            continue
        if kind == "mark" and value in (";", ",", *CLOSE):
            return j - 1
        if kind == "name" and value in ("of", "in") and j == k + 1:
            return j - 1
        if fresh and j > k + 1 and not (kind == "mark" and value in CONTINUES) and not (last[0] == "mark" and last[1] in CONTINUES):
            return j - 1
        if kind == "mark" and value in OPEN:
            j = closing(tokens, j)
        j += 1
    return len(tokens) - 1


def script_declarations(text: str, scanned: list[tuple[str, str, bool]] | None = None) -> list[tuple[str, list[str]]]:
    """LEX4: each declared function, class, interface, type, enum, method and variable with all identifiers within it."""
    t = script_scan(text) if scanned is None else scanned
    spans: list[tuple[str, int, int]] = []
    bodies: list[tuple[int, int]] = []
    for k, (kind, value, _) in enumerate(t):
        if kind != "name" or k + 1 >= len(t) or (k and t[k - 1][1] == "." and t[k - 1][0] == "mark"):
            continue
        nxt = k + 2 if t[k + 1][1] == "*" and value == "function" else k + 1
        if nxt >= len(t) or t[nxt][0] != "name":
            continue
        name = t[nxt][1]
        if value in ("function", "class", "interface", "enum") and name not in ("extends", "implements"):
            end = body_end(t, nxt)
            if value != "function" or k == 0 or t[k - 1][1] not in ("=", "(", ",", ":", "=>", "return"):
                spans.append((name, k, end))
            if value == "class":
                start = next((j for j in range(nxt, end) if t[j][1] == "{"), end)
                bodies.append((start, end))
        elif value == "type" and nxt + 1 < len(t) and t[nxt + 1][1] in ("=", "<"):
            spans.append((name, nxt, value_end(t, nxt, True)))
        elif value in ("const", "let", "var"):
            at = nxt
            while at < len(t) and t[at][0] == "name":
                end = value_end(t, at)
                spans.append((t[at][1], at, end))
                at = end + 2 if end + 1 < len(t) and t[end + 1][1] == "," else len(t)
    for start, end in bodies:
        j = start + 1
        while j < end:
            if t[j][0] == "mark" and t[j][1] in OPEN:
                opened, j = j, closing(t, j)
                if t[opened][1] == "(" and t[opened - 1][0] == "name" and t[opened - 1][1] not in ("if", "for", "while", "switch", "catch", "constructor"):
                    after = next((q for q in range(j + 1, end) if t[q][1] in ("{", ";")), end)
                    if t[after][1] == "{" and t[opened - 2][1] not in ("=", ".", "new"):
                        j = closing(t, after)
                        spans.append((t[opened - 1][1], opened - 1, j))
            j += 1
    return [(name, sorted({t[k][1] for k in range(start, end + 1) if is_identifier(t, k)})) for name, start, end in spans]


def script_imports(text: str, scanned: list[tuple[str, str, bool]] | None = None) -> list[str]:
    """LEX5: specifiers of import, export ... from, require() and import()."""
    t, out = script_scan(text) if scanned is None else scanned, []
    for k, (kind, value, _) in enumerate(t):
        if kind != "string" or not k:
            continue
        back = [x[1] for x in t[max(0, k - 2) : k]]
        if back[-1] == "from" and t[k - 1][0] == "name" or back[-1] == "import" and t[k - 1][0] == "name":
            out.append(value)
        elif back == ["require", "("] or back == ["import", "("]:
            out.append(value)
    return out


# Python

def python_identifiers(text: str) -> list[str]:
    """LEX3 for Python: every name of the token stream but keywords."""
    import keyword

    names = [x.string for x in tokenize.generate_tokens(io.StringIO(text).readline) if x.type == tokenize.NAME and not keyword.iskeyword(x.string)]
    return list(dict.fromkeys(names))


def python_definitions(text: str) -> list[str]:
    """LEX8 for Python: functions and classes, nested ones too."""
    return [x.name for x in ast.walk(ast.parse(text)) if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]


PYTHON_RELATIVE = re.compile(r"^[ \t]*from[ \t]+(\.+)([A-Za-z0-9_.]*)[ \t]+import[ \t]+(.+)$", re.M)


def python_relative_imports(text: str) -> list[tuple[int, str]]:
    """LEX6: (dots, module path with slashes) of each relative import; `from . import a, b` names modules a and b."""
    out = []
    for m in PYTHON_RELATIVE.finditer(text):
        dots, module, names = len(m[1]), m[2], m[3]
        if module:
            out.append((dots, "/".join(x for x in module.split(".") if x)))
        else:
            parts = (re.split(r"\s+as\s+", x.strip())[0].strip() for x in re.sub(r"[()]", "", names).split(","))
            out += [(dots, x) for x in parts if x]
    return out


QUOTED_IMPORT = re.compile(r"""(?:from|import|require)\s*\(?\s*["'](\.[^"']*)["']""")


def quoted_imports(text: str) -> list[str]:
    """LEX7: quoted relative specifiers of any other language."""
    return QUOTED_IMPORT.findall(text)


#: LEX9: absolute and relative specifiers in Python's form, as SQL patterns over whole texts.
FROM_IMPORT = r"(?m)^[ \t]*from[ \t]+([.\w]+)[ \t]+import\b"
PLAIN_IMPORT = r"(?m)^[ \t]*import[ \t]+([.\w]+)"


def import_specs(text: Column) -> Column:
    return F.concat(F.regexp_extract_all(text, F.lit(FROM_IMPORT), F.lit(1)), F.regexp_extract_all(text, F.lit(PLAIN_IMPORT), F.lit(1)))


# Other languages: comments and strings by table, then names, and definitions by pattern

COMMENTS = {"ruby": r"#[^\n]*|^=begin.*?^=end", "php": r"<\?php\b|//[^\n]*|#[^\n]*|/\*.*?\*/"}
KEYWORDS = {
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "ruby": "alias and begin break case class def defined do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new null package private protected public return short static strictfp super switch synchronized this throw throws transient true false try void volatile while",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self static struct super trait true type union unsafe use where while"
    " bool char str f32 f64 i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize",
    "php": "abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile extends final finally fn for foreach function global goto if implements include instanceof insteadof interface isset list match namespace new or print private protected public require return static switch throw trait try unset use var while xor yield",
    "c_sharp": "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using var virtual void volatile while",
}
DEFINITIONS = {
    "go": r"\bfunc\s+(?:\([^)]*\)\s*)?(\w+)|\btype\s+(\w+)",
    "ruby": r"\bdef\s+(?:self\.)?(\w+[?!=]?)|\bclass\s+(\w+)|\bmodule\s+(\w+)",
    "java": r"\b(?:class|interface)\s+(\w+)|(?:[\w<>\[\],.]+)\s+(\w+)\s*\([^;{}()]*\)\s*(?:throws\s+[\w.,\s]+)?\{",
    "rust": r"\bfn\s+(\w+)|\bstruct\s+(\w+)|\benum\s+(\w+)|\btrait\s+(\w+)",
    "php": r"\bfunction\s+&?(\w+)|\bclass\s+(\w+)",
    "c_sharp": r"\b(?:class|interface)\s+(\w+)|(?:[\w<>\[\],.?]+)\s+(\w+)\s*(?:<[^>]*>)?\([^;{}()]*\)\s*(?:where[^{]*)?(?:\{|=>)",
}
NOT_METHODS = frozenset("if for while switch catch return new else foreach using lock synchronized".split())


def plain_code(text: str, language: str) -> str:
    comment = COMMENTS.get(language, r"//[^\n]*|/\*.*?\*/")
    strings = r'"[^"\\\n]*(?:\\.[^"\\\n]*)*"|' + r"'[^'\\\n]*(?:\\.[^'\\\n]*)*'" + (r"|`[^`]*`" if language == "go" else "")
    return re.sub(f"{comment}|{strings}", " ", text, flags=re.S | re.M)


def table_identifiers(text: str, language: str) -> list[str]:
    """LEX3 for the other languages."""
    skip = set(KEYWORDS[language].split())
    return list(dict.fromkeys(x for x in re.findall(r"[A-Za-z_]\w*", plain_code(text, language)) if x not in skip))


def table_definitions(text: str, language: str) -> list[str]:
    """LEX8 for the other languages."""
    found = (next(x for x in m.groups() if x) for m in re.finditer(DEFINITIONS[language], plain_code(text, language)))
    return [x for x in found if x not in NOT_METHODS]


def plain_identifiers(text: str) -> list[str]:
    """LEX1 in Python, for what no lexer can read."""
    for pattern in STRIPPED:
        text = re.sub(pattern, " ", text)
    return list(dict.fromkeys(x for x in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", text) if x.lower() not in GENERIC_KEYWORDS))


def identifiers(text: str, ext: str) -> list[str]:
    """JN21, LEX10: by extension, and as plain text if that fails."""
    try:
        if ext in SCRIPT:
            return script_identifiers(text)
        if ext == ".py":
            return python_identifiers(text)
        if ext in LANGUAGES:
            return table_identifiers(text, LANGUAGES[ext])
    except (SyntaxError, IndentationError, tokenize.TokenError, ValueError, RecursionError):
        pass
    return plain_identifiers(text)


def definitions(text: str, ext: str) -> list[str]:
    """LEX8: empty for scripts, whose names count as symbols instead."""
    try:
        if ext == ".py":
            return python_definitions(text)
        if ext in LANGUAGES:
            return table_definitions(text, LANGUAGES[ext])
    except (SyntaxError, ValueError, RecursionError):
        pass
    return []


def imports(text: str, ext: str) -> list[tuple[str, int]]:
    """LEX5-7: (specifier, dots); dots are 0 but for Python's relative imports."""
    if ext == ".py":
        return [(path, dots) for dots, path in python_relative_imports(text)]
    specs = script_imports(text) if ext in SCRIPT else quoted_imports(text)
    return [(s, 0) for s in specs]


def findings(text: str, ext: str) -> tuple[list[str], list[str], list[tuple[str, int]], list[tuple[str, list[str]]]]:
    """identifiers(), definitions(), imports() and script_declarations(), a script being scanned once. A text of space alone holds none of them."""
    if not text or text.isspace():
        return [], [], [], []
    if ext not in SCRIPT:
        return identifiers(text, ext), definitions(text, ext), imports(text, ext), []
    try:
        t = script_scan(text)
    except (ValueError, RecursionError):
        return identifiers(text, ext), [], imports(text, ext), script_declarations(text)
    return script_identifiers(text, t), [], [(s, 0) for s in script_imports(text, t)], script_declarations(text, t)


LEXED = "path string, ext string, text string, identifiers array<string>, definitions array<string>, imports array<struct<spec:string,dots:int>>, declarations array<struct<name:string,refs:array<string>>>"

LEXED_COLUMNS = ("path", "ext", "text", "identifiers", "definitions", "imports", "declarations")


def lexed(files: DataFrame) -> DataFrame:
    """(path, ext, text) with all that any lexer finds, in one pass: matching, both graphs and the module map read from it."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = pa.list_(pa.string())
        types = [names, names, pa.list_(pa.struct([("spec", pa.string()), ("dots", pa.int32())])), pa.list_(pa.struct([("name", pa.string()), ("refs", names)]))]
        for b in batches:
            found = [findings(text or "", ext or "") for text, ext in zip(b.column("text").to_pylist(), b.column("ext").to_pylist())]
            lists = [[f[0] for f in found], [f[1] for f in found], [[{"spec": s, "dots": d} for s, d in f[2]] for f in found], [[{"name": n, "refs": x} for n, x in f[3]] for f in found]]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("path", "ext", "text")), *(pa.array(v, t) for v, t in zip(lists, types))], names=list(LEXED_COLUMNS))

    return files.select("path", "ext", "text").mapInArrow(run, LEXED)


def register(spark: SparkSession) -> None:
    """Makes lexers table functions of SQL: lex_tokens(text, ext) and lex_declarations(text, ext)."""

    class Tokens:
        def eval(self, text: str, ext: str):
            seen = set()
            for name in identifiers(text or "", ext or ""):
                parts = python_parts(name)
                if parts:
                    seen |= {("full", name.lower()), ("full", "".join(parts)), *(("part", p) for p in parts)}
            yield from sorted(seen)

    class Declarations:
        def eval(self, text: str, ext: str):
            if ext in SCRIPT:
                yield from script_declarations(text or "")
            else:
                yield from ((name, []) for name in definitions(text or "", ext or ""))

    spark.udtf.register("lex_tokens", F.udtf(Tokens, returnType="space string, token string"))
    spark.udtf.register("lex_declarations", F.udtf(Declarations, returnType="name string, refs array<string>"))


def python_parts(name: str) -> list[str]:
    """The words of an identifier as the columns of scalars.py split it."""
    apart = re.sub("([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub("([a-z0-9])([A-Z])", r"\1 \2", name))
    words = [w for w in re.split("[^a-z0-9]+", apart.lower()) if w]
    return [w[:-1] if len(w) > 4 and w.endswith("s") and not w.endswith("ss") else w for w in words]
