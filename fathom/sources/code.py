"""Declarations, references and imports out of Kotlin and Java text.

A tokenizer, not a grammar: comments and string contents are blanked, keywords
open declarations, braces give their extent, every other identifier is a
reference whose kind follows from its neighbours.  A file is parsed once; its
declarations, references and imports are rows of one table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions.scratch import stash

DECLS = "decl_id bigint, file string, module string, source_set string, begin int, end int, name string, fqn string, kind string, visibility string, line bigint, bytes bigint, lines bigint, parent_id bigint, anns string, supers string, mods string, type_name string, language string"
REFS = "file string, ref_id bigint, at int, name string, qualified string, kind string"
IMPORTS = "file string, ord int, path string"
_ALL = "what string, decl_id bigint, file string, module string, source_set string, begin int, end int, name string, fqn string, kind string, visibility string, line bigint, bytes bigint, lines bigint, parent_id bigint, anns string, supers string, mods string, type_name string, language string, qualified string"
_NAMES = [c.split()[0] for c in _ALL.split(", ")]
_NUMBERS = {c.split()[0] for c in _ALL.split(", ") if c.split()[1] in ("int", "bigint")}

_BLANK = re.compile(r'//[^\n]*|/\*.*?\*/|"""(?:.*?)"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'', re.S)
_MODS = r"(?:public|private|protected|internal|abstract|open|final|sealed|data|static|override|suspend|inline|operator|lateinit|const|companion|enum|annotation|value|inner|synchronized|volatile|transient|default|native|external|tailrec|infix)"
_HEAD = rf"(?P<anns>(?:@(?:get:|set:|field:|file:)?[\w.]+(?:\([^()]*\))?\s*)*)(?P<mods>(?:{_MODS}\s+)*)"
_KOTLIN = re.compile(_HEAD + r"(?P<kw>class|interface|object|fun|val|var|typealias|constructor)\b(?:[ \t]+<[^>{}]*>)?(?:[ \t]+(?:[A-Z]\w*(?:<[^>]*>)?\.)?(?P<name>\w+))?")
_JAVA_TYPE = re.compile(_HEAD + r"(?P<kw>class|interface|enum|record)[ \t]+(?P<name>\w+)")
_JAVA_MEMBER = re.compile(_HEAD + r"(?:<[^>]*>\s*)?(?P<type>[A-Za-z_][\w.]*(?:<[^;(){}]*>)?(?:\[\])*)\s+(?P<name>\w+)\s*(?P<next>[(;=])")
_JAVA_MADE = re.compile(_HEAD + r"(?P<name>[A-Z]\w*)\s*(?P<next>\()")
_WORD = re.compile(r"[A-Za-z_]\w*")
_CHAIN = re.compile(r"[A-Za-z_]\w*(?:\s*\.\s*[A-Za-z_]\w*)*")
_MARK = re.compile(r"@(?:\w+:)?$")
_AFTER = re.compile(r"\s*(\(|\{|<[\w<>?, .]*>\s*\(|(?:[-+*/]=|=(?!=)))?")
_BRACES = re.compile(r"[{}]")
_IMPORT = re.compile(r"^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.*]+(?:[ \t]+as[ \t]+\w+)?)", re.M)
_PRIMITIVES = {"int", "long", "boolean", "void", "char", "byte", "short", "float", "double"}
_KEYWORDS = set("class interface object fun val var typealias if else while for do when return import package in is as this super null true false try catch finally throw new extends implements throws instanceof switch case break continue by get set where constructor init out it record".split()) | _PRIMITIVES | set(re.findall(r"\w+", _MODS))
TYPES = ("Class", "Interface", "Object", "Enum", "Annotation")


def blank(text: str) -> str:
    """Comments and string contents as spaces; lines and offsets stay."""
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _close(text: str, at: int) -> int:
    """The place after the brace that closes the one at ``at``."""
    deep = 0
    for m in _BRACES.finditer(text, at):
        deep += 1 if m.group() == "{" else -1
        if deep == 0:
            return m.end()
    return len(text)


def _past(text: str, at: int, pair: str = "()") -> int:
    deep = 0
    for k in range(at, len(text)):
        deep += (text[k] == pair[0]) - (text[k] == pair[1])
        if deep == 0:
            return k + 1
    return len(text)


def _line_end(text: str, at: int) -> int:
    deep, k = 0, at
    while k < len(text):
        deep += (text[k] in "({[") - (text[k] in ")}]")
        if deep < 0 or (deep == 0 and text[k] == "\n"):
            return k
        k += 1
    return k


def _split(text: str, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Parts between commas outside of any brackets."""
    deep, last = 0, begin
    for k in range(begin, end):
        ch = text[k]
        deep += (ch in "({[<") - (ch in ")}]>" and text[k - 1 : k + 1] != "->")
        if ch == "," and deep == 0:
            yield last, k
            last = k + 1
    if text[last:end].strip():
        yield last, end


@dataclass
class Parsed:
    """What a file has: declarations with the index of their parent, references (offset, name, qualified name, kind), imports."""

    decls: list[dict]
    refs: list[tuple[int, str, str | None, str]]
    imports: list[str]


def parse(text: str, java: bool) -> Parsed:
    """Declarations, references and imports of one file."""
    code = blank(text)
    found: list[dict] = []
    taken: set[int] = set()
    clauses: list[tuple[int, int]] = []

    def add(m: re.Match, kind: str, end: int, supers: str = "", type_name: str = "", extra: str = "") -> None:
        mods = m["mods"].split() + ([extra] if extra else [])
        where = text[m.start("anns") : m.end("anns")]
        anns = " ".join(a + (args.replace(" ", "") if "Suppress" in a else "") for a, args in re.findall(r"@(?:\w+:)?([\w.]+)(\([^()]*\))?", where))
        default = "PackagePrivate" if java else "Public"
        vis = next((x.capitalize() for x in mods if x in ("public", "private", "protected", "internal")), default)
        begin = m.start() + len(m.group()) - len(m.group().lstrip())
        found.append({"begin": begin, "end": end, "name": m["name"] or ("Companion" if kind == "Object" else "constructor"), "kind": kind, "visibility": vis, "anns": anns, "supers": supers, "mods": " ".join(mods), "type": type_name})
        if m["name"]:
            taken.add(m.start("name"))

    def params(at: int, stop: int) -> None:
        """Parameters between the parentheses at ``at``; those with val or var are properties."""
        for b, e in _split(code, at + 1, stop - 1):
            part = code[b:e]
            m = re.match(r"\s*(?:@[\w.]+(?:\([^()]*\))?\s*)*(?:(?:final|vararg|private|protected|internal|public|override|noinline|crossinline)\s+)*" + (r"[\w.<>\[\]?, ]+?[\s.]+(\w+)\s*$" if java else r"(?:(val|var)\s+)?(\w+)\s*:\s*([\w.<>?, ]+)"), part)
            if m is None:
                continue
            n = 1 if java else 2
            own = b + m.start(n)
            prop = None if java else m[1]
            private = re.search(r"\bprivate\b", part[: m.start(n)])
            vis = "Private" if private or not prop else "Public"
            found.append({"begin": own, "end": own + len(m[n]), "name": m[n], "kind": "Property" if prop else "Parameter", "visibility": vis, "anns": " ".join(re.findall(r"@(?:\w+:)?([\w.]+)", part)), "supers": "", "mods": prop or "", "type": "" if java else m[3].strip()})
            taken.add(own)

    def cases(brace: int, end: int) -> None:
        body_end = end - 1
        semi = code.find(";", brace, body_end)
        for b, e in _split(code, brace + 1, semi if semi >= 0 else body_end):
            m = re.match(r"\s*(?:@\w+(?:\([^()]*\))?\s*)*([A-Z]\w*)\b(?!\s*:)", code[b:e])
            if m:
                own = b + m.start(1)
                found.append({"begin": own, "end": max(own + len(m[1]), b + len(code[b:e].rstrip())), "name": m[1], "kind": "EnumCase", "visibility": "Public", "anns": " ".join(re.findall(r"@([\w.]+)", code[b : own])), "supers": "", "mods": "", "type": ""})
                taken.add(own)

    for m in (_JAVA_TYPE if java else _KOTLIN).finditer(code):
        kw = m["kw"]
        if m["name"] is None and kw not in ("object", "constructor") or m["name"] and m.start("name") in taken:
            continue
        at = m.end()
        if kw in ("class", "interface", "object", "enum", "record"):
            skip = re.compile(r"\s*(?:<[^{}()]*?>)?\s*(?:(?:private|internal|protected|public|@\w+)\s+)*(?:constructor\s*)?").match(code, at)
            paren = skip.end() if skip else at
            if paren < len(code) and code[paren] == "(" and kw != "object" and (not java or kw == "record"):
                stop = _past(code, paren)
                params(paren, stop)
                at = stop
            head = re.compile(r"[^{;\n]*(?:\n[ \t]*(?:extends|implements|:|,)[^{;\n]*)*").match(code, at).group()
            brace = at + len(head)
            clauses.append((at, brace))
            clause = head.split(":", 1)[-1] if not java and ":" in head else re.sub(r"^.*?\b(?:extends|implements)\b", "", head, count=1) if java and re.search(r"\b(extends|implements)\b", head) else ""
            names = [re.sub(r"\s+", "", n) for n in re.findall(r"[A-Za-z_][\w.]*(?:<[^{}()]*>)?(?:\([^()]*\))?", clause) if n not in ("by", "extends", "implements", "where", "permits")]
            names = [n for n in names if re.split(r"[.<(]", n)[-1 if "." in n and "<" not in n and "(" not in n else 0]]
            kind = {"class": "Class", "interface": "Interface", "object": "Object", "enum": "Enum", "record": "Class"}[kw]
            kind = "Enum" if "enum" in m["mods"].split() else "Annotation" if "annotation" in m["mods"].split() else kind
            end = _close(code, brace) if brace < len(code) and code[brace] == "{" else brace
            add(m, kind, end, " ".join(names))
            if kind == "Enum" and end > brace:
                cases(brace, end)
        elif kw in ("fun", "constructor"):
            paren = code.find("(", at)
            stop = _past(code, paren) if paren >= 0 else at
            body = re.compile(r"[^{=\n]*").match(code, stop).group()
            k = stop + len(body)
            end = _close(code, k) if k < len(code) and code[k] == "{" else _line_end(code, k)
            kind = "Constructor" if kw == "constructor" else "Function"
            made = re.match(r"\s*:\s*([\w.<>?]+)", body)
            add(m, kind, end, "", made[1] if made and kw == "fun" else "")
            if paren >= 0:
                params(paren, stop)
        else:
            typed = re.compile(r"\s*:\s*([\w.<>?, ]+?)\s*(?:=|\n|\{|by\b|$)").match(code, at)
            add(m, "TypeAlias" if kw == "typealias" else "Property", _line_end(code, at), "", typed[1] if typed else "", kw if kw in ("val", "var") else "")
    if java:
        types = {d["name"] for d in found}
        for m in _JAVA_MEMBER.finditer(code):
            if m["type"] in _KEYWORDS - _PRIMITIVES or m["name"] in _KEYWORDS:
                continue
            if m["next"] == "(":
                stop = _past(code, m.end() - 1)
                k = stop + len(re.compile(r"[^{;]*").match(code, stop).group())
                end = _close(code, k) if k < len(code) and code[k] == "{" else k
                add(m, "Method", end, "", m["type"])
                params(m.end() - 1, stop)
            else:
                add(m, "Field", code.find(";", m.start("name")) + 1 or len(code), "", m["type"])
        for m in _JAVA_MADE.finditer(code):
            before = code[: m.start()].rstrip()[-4:]
            stop = _past(code, m.end() - 1)
            opens = re.compile(r"\s*(?:throws[^{;]*)?\{").match(code, stop)
            if m["name"] in types and opens and m.start("name") not in taken and not before.endswith(("new", ".", "=")):
                add(m, "Constructor", _close(code, opens.end() - 1))
                params(m.end() - 1, stop)
    found.sort(key=lambda d: (d["begin"], -d["end"]))
    stack: list[int] = []
    kept: list[dict] = []
    for d in found:
        while stack and kept[stack[-1]]["end"] < d["end"]:
            stack.pop()
        while stack and kept[stack[-1]]["end"] <= d["begin"]:
            stack.pop()
        d["parent"] = stack[-1] if stack else None
        up = kept[stack[-1]]["kind"] if stack else None
        if d["kind"] in ("Property", "Field") and up in ("Function", "Method", "Constructor") or d["kind"] == "Constructor" and up not in TYPES:
            continue  # a local
        if d["kind"] == "Function" and up in TYPES:
            d["kind"] = "Method"
        kept.append(d)
        stack.append(len(kept) - 1)
    imports = [m[1] for m in _IMPORT.finditer(code)]
    spans = [(m.start(), m.end()) for m in re.finditer(r"^[ \t]*(?:import|package)\b[^\n]*", code, re.M)]
    first_body = max((e for _, e in spans), default=0)
    refs: list[tuple[int, str, str | None, str]] = []
    for chain in _CHAIN.finditer(code):
        if chain.start() < first_body and any(a <= chain.start() < b for a, b in spans):
            continue
        path: list[str] = []
        for m in _WORD.finditer(code, chain.start(), chain.end()):
            path.append(m.group())
            if m.group() in _KEYWORDS or m.start() in taken or _MARK.search(code[max(0, m.start() - 9) : m.start()]):
                continue
            after = _AFTER.match(code, m.end())[1] or ""
            k = m.start() - 1
            while k >= 0 and code[k] in " \t\n":
                k -= 1
            before = code[k] if k >= 0 else ""
            word = re.search(r"\w*$", code[max(0, k - 10) : k + 1])[0]
            if any(a <= m.start() < b for a, b in clauses):
                kind = "Inheritance"
            elif after.endswith("("):
                kind = "Instantiation" if m.group()[0].isupper() else "Call"
            elif before in (":", "<") or word in ("new", "is", "as"):
                kind = "Type"
            else:
                kind = "Write" if after.endswith("=") and m.end() == chain.end() else "Read"
            refs.append((m.start(), m.group(), ".".join(path) if len(path) > 1 else None, kind))
    return Parsed(kept, refs, imports)


def _surrogate(file: str, begin: int, end: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{file}:{begin}:{end}") - (1 << 63)


@dataclass
class Extracted:
    """Declarations, references and imports of files; all read one stash."""

    decls: DataFrame
    refs: DataFrame
    imports: DataFrame


def extract(files: DataFrame) -> Extracted:
    """What the files (file, content, language, module, source_set) have; null contents count as empty."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for file, text, lang, module, sset in zip(pdf["file"], pdf["content"], pdf["language"], pdf["module"], pdf["source_set"]):
                text = text or ""
                package = re.search(r"^\s*package\s+([\w.]+)", text, re.M)
                p = parse(text, lang == "Java")
                fqn: list[str] = []
                for d in p.decls:
                    top = (package[1] + ".") if package else ""
                    fqn.append((fqn[d["parent"]] + "." if d["parent"] is not None else top) + d["name"])
                    up = p.decls[d["parent"]] if d["parent"] is not None else None
                    body = text[d["begin"] : d["end"]]
                    out.append(("d", _surrogate(file, d["begin"], d["end"]), file, module, sset, d["begin"], d["end"], d["name"], fqn[-1], d["kind"], d["visibility"], text.count("\n", 0, d["begin"]) + 1, len(body.encode()), body.count("\n") + 1,
                                _surrogate(file, up["begin"], up["end"]) if up else None, d["anns"], d["supers"], d["mods"], d["type"], lang, None))
                for at, name, qualified, kind in p.refs:
                    out.append(("r", _surrogate(file, at, -1), file, None, None, at, None, name, None, kind, None, None, None, None, None, None, None, None, None, None, qualified))
                for k, path in enumerate(p.imports):
                    out.append(("i", None, file, None, None, k, None, path, None, None, None, None, None, None, None, None, None, None, None, None, None))
            # numbers never pass through floats, which would round identifiers
            columns = zip(_NAMES, zip(*out)) if out else ((n, ()) for n in _NAMES)
            yield pd.DataFrame({n: pd.array(list(c), "Int64") if n in _NUMBERS else pd.Series(list(c), dtype=object) for n, c in columns})

    x = stash(files.where("ext in ('kt', 'java')").select("file", "content", "language", "module", "source_set").mapInPandas(run, _ALL))
    pick = lambda what, schema: x.where(F.col("what") == what).select(*[c.split()[0] for c in schema.split(", ")])
    refs = x.where("what = 'r'").select("file", F.col("decl_id").alias("ref_id"), F.col("begin").alias("at"), "name", "qualified", "kind")
    imports = x.where("what = 'i'").select("file", F.col("begin").alias("ord"), F.col("name").alias("path"))
    return Extracted(pick("d", DECLS), refs, imports)
