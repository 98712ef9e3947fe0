"""Findings written out: JSON lines and CSV by Spark; the forms of other tools row by row.

Renderers read one partition at a time and take findings in report order, with
code, kind, name, file and line, and confidence where they have one.
"""

from __future__ import annotations

import hashlib
import html
import json
from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

LEVEL = {"Low": "note", "Medium": "warning", "High": "warning", "Confirmed": "error"}
SEVERITY = {"Low": "info", "Medium": "minor", "High": "major", "Confirmed": "critical"}


def _rows(findings: DataFrame) -> Iterator[Row]:
    return findings.toLocalIterator()


def _confidence(r: Row) -> str:
    return r["confidence"] if "confidence" in r and r["confidence"] else "Medium"


def _said(r: Row) -> str:
    notes = [n for n in (r["notes"] or [])] if "notes" in r else []
    return f"{r['kind']} {r['name']}" + "".join(f" [{n}]" for n in notes)


def write_json(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").json(path)


def write_csv(findings: DataFrame, path: str) -> None:
    flat = [F.array_join(f.name, "; ").alias(f.name) if f.dataType.simpleString().startswith("array") else F.col(f.name) for f in findings.schema]
    findings.select(*flat).write.mode("overwrite").option("header", "true").csv(path)


def sarif(findings: DataFrame) -> str:
    """A SARIF 2.1.0 log with the rules that occur."""
    results, codes = [], {}
    for r in _rows(findings):
        index = codes.setdefault(r["code"], len(codes))
        place = {"artifactLocation": {"uri": r["file"]}, "region": {"startLine": max(1, r["line"])}}
        results.append({"ruleId": r["code"], "ruleIndex": index, "level": LEVEL[_confidence(r)], "message": {"text": _said(r)}, "locations": [{"physicalLocation": place}]})
    driver = {"name": "fathom", "rules": [{"id": c} for c in codes]}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": results}]})


def checkstyle(findings: DataFrame) -> str:
    """One file element a file."""
    out, last = ['<checkstyle version="8.0">'], None
    for r in _rows(findings):
        if r["file"] != last:
            out += ["</file>"] * (last is not None) + [f"<file name={quoteattr(r['file'])}>"]
            last = r["file"]
        out.append(f'<error line="{r["line"]}" severity="{LEVEL[_confidence(r)].replace("note", "info")}" message={quoteattr(_said(r))} source={quoteattr(r["code"])}/>')
    return "\n".join(out + ["</file>"] * (last is not None) + ["</checkstyle>"])


def markdown(findings: DataFrame) -> str:
    cell = lambda x: str(x).replace("|", r"\|")
    rows = [f"| {r['code']} | {cell(r['file'])}:{r['line']} | {cell(_said(r))} |" for r in _rows(findings)]
    return "\n".join(["| rule | place | declaration |", "|-|-|-|", *rows])


def gitlab(findings: DataFrame) -> str:
    """A code quality report; a finding's fingerprint is of its rule, file, kind and name, so it outlives moved lines."""
    out = []
    for r in _rows(findings):
        mark = hashlib.md5(f"{r['code']}:{r['file']}:{r['kind']}:{r['name']}".encode()).hexdigest()
        place = {"path": r["file"], "lines": {"begin": max(1, r["line"])}}
        out.append({"description": _said(r), "check_name": r["code"], "fingerprint": mark, "severity": SEVERITY[_confidence(r)], "location": place})
    return json.dumps(out)


def reviewdog(findings: DataFrame) -> str:
    """One JSON object a line, for review comments."""
    level = {"note": "INFO", "warning": "WARNING", "error": "ERROR"}
    rows = [{"message": _said(r), "location": {"path": r["file"], "range": {"start": {"line": max(1, r["line"])}}}, "severity": level[LEVEL[_confidence(r)]], "code": {"value": r["code"]}} for r in _rows(findings)]
    return "\n".join(json.dumps(r) for r in rows)


def compact(findings: DataFrame) -> str:
    """A line a finding, as compilers have it."""
    return "\n".join(f"{r['file']}:{r['line']}: {r['code']} {_said(r)}" for r in _rows(findings))


def terminal(findings: DataFrame) -> str:
    """Findings below their file, with the number of all."""
    out, last, n = [], None, 0
    for r in _rows(findings):
        if r["file"] != last:
            out += [""] * (last is not None) + [r["file"]]
            last = r["file"]
        out.append(f"  {r['line']:>5}  {r['code']:<7} {_confidence(r):<9} {_said(r)}")
        n += 1
    return "\n".join([*out, "", f"{n} findings"] if n else ["nothing found"])


def web_page(findings: DataFrame, title: str = "Findings") -> str:
    """A page with one table."""
    cells = lambda r: "".join(f"<td>{html.escape(str(x))}</td>" for x in (r["code"], _confidence(r), f"{r['file']}:{r['line']}", _said(r)))
    rows = "".join(f"<tr>{cells(r)}</tr>" for r in _rows(findings))
    head = "".join(f"<th>{h}</th>" for h in ("rule", "confidence", "place", "declaration"))
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><table><thead><tr>{head}</tr></thead><tbody>{rows}</tbody></table>"


def summary_text(findings: DataFrame) -> str:
    """Counts by rule, most first, for the description of a change."""
    n = findings.groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "code").collect()
    return "\n".join([f"{sum(r['n'] for r in n)} findings", "", "| rule | findings |", "|-|-|", *[f"| {r['code']} | {r['n']} |" for r in n]])


def badge(findings: DataFrame) -> str:
    """What a badge service asks for: a label, the number of findings, a colour."""
    n = findings.count()
    colour = "brightgreen" if n == 0 else "yellow" if n < 50 else "orange"
    return json.dumps({"schemaVersion": 1, "label": "dead code", "message": str(n), "color": colour})


def removal_patch(findings: DataFrame, files: DataFrame) -> str:
    """A unified diff that removes whole lines of the findings' declarations (file, begin line ``line``, ``lines`` of them); ``files`` is (file, content).

    Of nested declarations the outer one counts.
    """
    spans = findings.select("file", F.col("line").alias("a"), (F.col("line") + F.col("lines") - 1).alias("z")).groupBy("file").agg(F.array_sort(F.collect_set(F.struct("a", "z"))).alias("s"))
    out = []
    for r in spans.join(files.select("file", "content"), "file").orderBy("file").toLocalIterator():
        text = r["content"].split("\n")
        out += [f"--- a/{r['file'].lstrip('/')}", f"+++ b/{r['file'].lstrip('/')}"]
        gone, done = 0, 0
        for s in r["s"]:
            a, z = max(s["a"], done + 1), s["z"]
            if a > z:
                continue
            out.append(f"@@ -{a},{z - a + 1} +{a - 1 - gone},0 @@")
            out += [f"-{x}" for x in text[a - 1 : z]]
            gone, done = gone + z - a + 1, z
    return "\n".join(out) + ("\n" if out else "")


def write_baseline(findings: DataFrame, path: str, version: str = "1") -> None:
    """All findings as a baseline that ``read_baseline`` reads."""
    one = F.struct("file", "name", "kind", F.col("line").cast("int").alias("line"), F.col("fqn") if "fqn" in findings.columns else F.lit(None).cast("string").alias("fqn"), F.col("code").alias("rule"))
    g = findings.agg(F.array_sort(F.collect_list(one)).alias("issues"))
    g.select(F.lit(version).alias("version"), F.unix_timestamp().cast("string").alias("created_at"), F.size("issues").cast("bigint").alias("total_at_baseline"), "issues").coalesce(1).write.mode("overwrite").json(path)


def write_graph(decls: DataFrame, edges: DataFrame, roots: DataFrame, path: str) -> None:
    """Nodes, edges and roots, each as JSON lines below ``path``; numbers become names, as saved graphs have them."""
    decls.select(F.col("decl_id").cast("string").alias("id"), "name", "kind", "file", F.col("line").cast("int").alias("line")).write.mode("overwrite").json(f"{path}/nodes")
    edges.select(F.col("src").cast("string").alias("from"), F.col("dst").cast("string").alias("to")).distinct().write.mode("overwrite").json(f"{path}/edges")
    roots.select(F.col("decl_id").cast("string").alias("id")).distinct().write.mode("overwrite").json(f"{path}/roots")


def dot(decls: DataFrame, edges: DataFrame) -> Iterator[str]:
    """Lines of a DOT graph."""
    yield "digraph code {"
    for r in decls.select("decl_id", "name").toLocalIterator():
        yield f'  n{str(r["decl_id"]).replace("-", "m")} [label={json.dumps(r["name"])}];'
    for r in edges.select("src", "dst").distinct().toLocalIterator():
        yield f'  n{str(r["src"]).replace("-", "m")} -> n{str(r["dst"]).replace("-", "m")};'
    yield "}"
