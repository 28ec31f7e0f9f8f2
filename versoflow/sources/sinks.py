"""Outputs: idempotent appends, JSON lines, receipts and readable archives of a book."""

from __future__ import annotations

import hashlib
import html
import io
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_new(new: DataFrame, have: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``have``, each key once: what an idempotent append writes."""
    return new.dropDuplicates(key).join(have.select(*key).distinct(), key, "left_anti")


def merge_rows(have: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Upsert: rows of ``new`` replace those of the same key, others stay."""
    return have.join(new.select(*key).distinct(), key, "left_anti").unionByName(new.dropDuplicates(key))


def json_lines(df: DataFrame) -> DataFrame:
    """One compact JSON object a row, keys sorted, nulls kept."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("value"))


def report(lines: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Rows nested under their group as one JSON document a group."""
    body = F.sort_array(F.collect_list(F.struct(*columns)))
    return lines.groupBy(*by).agg(F.to_json(body).alias("document"))


def receipt(data: bytes, **options: object) -> dict[str, object]:
    """What goes beside an exported file: its digest, size and how it was made."""
    return {"schema_version": 1, "sha256": hashlib.sha256(data).hexdigest(), "byte_size": len(data), "options": dict(sorted(options.items()))}


def book_archive(title: str, identifier: str, language: str, chapters: list[tuple[str, list[str]]]) -> bytes:
    """A reflowable book of ordered chapters; equal input gives equal bytes.

    One book is written by one process, from paragraphs that the cluster has assembled.
    """
    esc, out = html.escape, io.BytesIO()
    page = lambda t, body: f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml" xml:lang="{esc(language)}"><head><title>{esc(t)}</title></head><body>{body}</body></html>'
    names = [f"chapter-{k:04d}.xhtml" for k in range(len(chapters))]
    items = "".join(f'<item id="c{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, n in enumerate(names))
    spine = "".join(f'<itemref idref="c{k}"/>' for k in range(len(names)))
    nav = "".join(f'<li><a href="{n}">{esc(t)}</a></li>' for n, (t, _) in zip(names, chapters, strict=True))
    files = {
        "META-INF/container.xml": '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>',
        "book.opf": f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{esc(identifier)}</dc:identifier><dc:title>{esc(title)}</dc:title><dc:language>{esc(language)}</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/>{items}</manifest><spine>{spine}</spine></package>',
        "nav.xhtml": page(title, f'<nav xmlns:epub="http://www.idpf.org/2007/ops" epub:type="toc"><ol>{nav}</ol></nav>'),
        **{n: page(t, f"<h1>{esc(t)}</h1>" + "".join(f"<p>{esc(p)}</p>" for p in ps)) for n, (t, ps) in zip(names, chapters, strict=True)},
    }
    with zipfile.ZipFile(out, "w") as z:
        for name, data in {"mimetype": "application/epub+zip", **files}.items():
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            z.writestr(info, data)
    return out.getvalue()


def archive_text(data: bytes) -> str:
    """All text of such an archive in reading order, white space aside; to check that nothing was lost."""
    import re

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        bodies = [z.read(n).decode() for n in sorted(x for x in z.namelist() if x.startswith("chapter-"))]
    return re.sub(r"\s+", "", "".join(html.unescape(re.sub(r"<[^>]+>", "", b[b.index("<body>") :])) for b in bodies))
