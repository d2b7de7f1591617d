"""Word packages read with the binaryFile source: verdicts and block elements."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from itertools import product
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from wordloom.functions.text import BLOCKING

_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_READ_ERRORS = (KeyError, RuntimeError, zipfile.BadZipFile)

# Verdict codes of the package rules.
BAD_TYPE, INVALID, CORRUPT, LOCKED, TOO_LARGE = "DOC-001", "DOC-002", "DOC-003", "DOC-004", "DOC-005"


def _part_problem(package: zipfile.ZipFile, name: str, locked_words: bool) -> str | None:
    """What is wrong with a required XML part, if anything."""
    try:
        data = package.read(name)
    except _READ_ERRORS:
        return CORRUPT
    low = data.lower()
    if locked_words and b"encrypted" in low and b"package" in low:
        return LOCKED
    return CORRUPT if b"<!DOCTYPE" in data or b"<!ENTITY" in data else None


def verdict(path: str, content: bytes | None, max_bytes: int = 10 << 20, max_parts: int = 1000, max_expanded: int = 100 << 20) -> str:
    """OK, or the code of the first rule that a file breaks."""
    data = content or b""
    if not path.lower().endswith(".docx"):
        return BAD_TYPE
    if not data:
        return INVALID
    if len(data) > max_bytes:
        return TOO_LARGE
    if data[:4] != b"PK\x03\x04" or not zipfile.is_zipfile(io.BytesIO(data)):
        return INVALID
    try:
        package = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return CORRUPT
    with package:
        parts = package.infolist()
        names = {p.filename for p in parts}
        rules = (
            (len(parts) > max_parts, CORRUPT),
            (sum(p.file_size for p in parts) > max_expanded, TOO_LARGE),
            (any(p.flag_bits & 1 for p in parts) or bool(names & {"EncryptedPackage", "EncryptionInfo", "encryptedPackage"}), LOCKED),
            ("[Content_Types].xml" not in names, CORRUPT),
        )
        for broken, code in rules:
            if broken:
                return code
        return _part_problem(package, "[Content_Types].xml", True) or ("word/document.xml" not in names and CORRUPT) or _part_problem(package, "word/document.xml", False) or "OK"


def audit_packages(files: DataFrame, max_bytes: int = 10 << 20, max_parts: int = 1000, max_expanded: int = 100 << 20) -> DataFrame:
    """(path, content) -> (path, code) for every file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(batch.schema.get_field_index("path"))
            codes = [verdict(p or "", c, max_bytes, max_parts, max_expanded) for p, c in zip(paths.to_pylist(), batch.column(batch.schema.get_field_index("content")).to_pylist())]
            yield pa.RecordBatch.from_arrays([paths, pa.array(codes, pa.string())], names=["path", "code"])

    return files.select("path", "content").mapInArrow(run, "path string, code string")


def _text(node: ElementTree.Element) -> str:
    pieces = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join(x.text or "" if x.tag == f"{_W}t" else pieces.get(x.tag, "") for x in node.iter())


def _style(paragraph: ElementTree.Element) -> str:
    node = paragraph.find(f"{_W}pPr/{_W}pStyle")
    return node.get(f"{_W}val", "Normal") if node is not None else "Normal"


def _style_names(package: zipfile.ZipFile) -> dict[str, str]:
    if "word/styles.xml" not in package.namelist():
        return {}
    named = ((x.get(f"{_W}styleId"), x.find(f"{_W}name")) for x in ElementTree.fromstring(package.read("word/styles.xml")).iter(f"{_W}style"))
    return {key: name.get(f"{_W}val", key) for key, name in named if key and name is not None}


def _body_blocks(body: ElementTree.Element | None, names: dict[str, str]) -> tuple[list[tuple[str, str]], int]:
    """(text, style with a gap for the order) of paragraphs, and of table cells row by row, each merged cell once; and how
    many paragraphs and tables there are."""
    out: list[tuple[str, str]] = []
    place = paragraphs = tables = 0
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            if text := _text(node).strip():
                style = _style(node)
                out.append((text, f"body_block_order:{{order}}:{place}:{paragraphs}:" + names.get(style, style).replace("{", "{{").replace("}", "}}")))
            paragraphs += 1
        elif node.tag == f"{_W}tbl":
            for r, row in enumerate(node.findall(f"{_W}tr")):
                for c, cell in enumerate(row.findall(f"{_W}tc")):
                    merge = cell.find(f"{_W}tcPr/{_W}vMerge")
                    if merge is not None and merge.get(f"{_W}val") != "restart":
                        continue  # the lower part of a merged cell
                    for p, paragraph in enumerate(cell.findall(f"{_W}p")):
                        if text := _text(paragraph).strip():
                            out.append((text, f"table_paragraph_order:{{order}}:{place}:{tables}:{r}:{c}:{p}"))
            tables += 1
        else:
            continue
        place += 1
    return out, place


def _shown_parts(root: ElementTree.Element) -> list[tuple[str, str, int, str]]:
    """(kind, relationship, section it comes from, variant) of headers and footers, a physical part once, as first shown.

    A section without a reference of its own shows the last earlier one of that kind and variant.
    """
    current: dict[tuple[str, str], tuple[int, str]] = {}
    first: dict[tuple[str, str], tuple] = {}
    for section, node in enumerate(root.iter(f"{_W}sectPr")):
        for rank, (kind, variant) in enumerate(product(("header", "footer"), ("default", "first", "even"))):
            own = [x for x in node.findall(f"{_W}{kind}Reference") if x.get(f"{_W}type", "default") == variant]
            if own:
                if not (relationship := own[0].get(f"{_R}id")):
                    continue
                current[kind, variant] = (section, relationship)
            if (kind, variant) in current:
                source, relationship = current[kind, variant]
                first.setdefault((kind, relationship), (section, kind == "footer", rank, relationship, source, variant))
    ordered = sorted(first.items(), key=lambda x: x[1][:4])
    return [(kind, relationship, x[4], x[5]) for (kind, relationship), x in ordered]


def _part_paragraphs(node: ElementTree.Element, blocked: bool = False) -> Iterator[tuple[str, bool]]:
    """(text, whether it holds or is in a structure that blocks editing) of all paragraphs of a header or footer."""
    for x in node:
        here = blocked or x.tag.removeprefix(_W) in BLOCKING
        if x.tag == f"{_W}p":
            yield _text(x).strip(), here or any(y.tag.removeprefix(_W) in BLOCKING for y in x.iter())
        yield from _part_paragraphs(x, here)


def elements(content: bytes) -> list[tuple[int, str, str]]:
    """(order, style, text) of a package: headers, body and footers. A header's or footer's paragraph without text stays if
    it has content that blocks editing."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        root = ElementTree.fromstring(package.read("word/document.xml"))
        body, places = _body_blocks(root.find(f"{_W}body"), _style_names(package))
        names = package.namelist()
        links = {}
        if "word/_rels/document.xml.rels" in names:
            links = {x.get("Id"): posixpath.normpath(posixpath.join("word", x.get("Target", ""))).removeprefix("/") for x in ElementTree.fromstring(package.read("word/_rels/document.xml.rels"))}
        parts: dict[str, list[tuple[str, str]]] = {"header": [], "footer": []}
        for kind, relationship, section, variant in _shown_parts(root):
            if links.get(relationship) in names:
                for n, (text, blocked) in enumerate(_part_paragraphs(ElementTree.fromstring(package.read(links[relationship])))):
                    if text or blocked:
                        parts[kind].append((text, f"{kind}:{section}:{variant}:{n}:{relationship}"))
    out = [(i, f"header_footer_order:{i}:{i}:{style}", text) for i, (text, style) in enumerate(parts["header"])]
    out += [(i, style.format(order=i), text) for i, (text, style) in enumerate(body, len(out))]
    after = places + len(parts["header"])
    return out + [(len(out) + k, f"header_footer_order:{len(out) + k}:{after + k}:{style}", text) for k, (text, style) in enumerate(parts["footer"])]


def extract_docx(files: DataFrame) -> DataFrame:
    """(path, content) -> (path, order, style, text) of every valid package; others give no rows (see audit_packages)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(batch.schema.get_field_index("path")).to_pylist(), batch.column(batch.schema.get_field_index("content")).to_pylist()):
                rows = elements(content) if verdict(path or "", content) == "OK" else []
                cols = list(zip(*rows)) if rows else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.string())))], names=["path", "order", "style", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, `order` int, style string, text string")
