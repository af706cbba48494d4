"""Chunkers: fixed windows as an expression; sentence-aware and markdown chunkers as pandas UDFs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import small_batches

SIZE, OVERLAP = 500, 50
SEPARATORS = ["。", "！", "？", ".", "!", "?", "\n"]  # fixed order: an earlier one wins wherever it stands
RESTARTS = "。！？\n；;，,"


def fixed_windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows of ``size`` characters, each starting ``size - overlap`` after the last; none of an empty text."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))
    return F.when(F.length(text) > 0, parts).otherwise(F.array().cast("array<string>"))


def _joint(text: str, at: int) -> bool:
    """Whether place ``at`` is inside an ASCII word."""
    a, b = text[at - 1], text[at]
    return a.isascii() and a.isalnum() and b.isascii() and b.isalnum()


def _cut(text: str, start: int, size: int) -> int:
    """End of the chunk from ``start``; past the text's end for the last one."""
    end = start + size
    if end < len(text):
        for sep in SEPARATORS:
            at = text.rfind(sep, start, end)
            if at - start > size // 2:
                return at + 1
    return end


def _resume(text: str, start: int, end: int, overlap: int) -> int:
    """Where the chunk after ``start:end`` starts: after the next pause in the overlap, else at the start of a word."""
    at = max(end - overlap, start + 1)
    for i in range(at, min(len(text), end, at + max(2 * overlap, 100))):
        if text[i] in RESTARTS:
            rest = text[i + 1 :]
            after = i + 1 + len(rest) - len(rest.lstrip())
            if after < end:
                return after
    while start + 1 < at < len(text) and _joint(text, at):
        at -= 1
    return at


def split_text(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    out, start = [], 0
    text = text or ""
    while start < len(text):
        end = _cut(text, start, size)
        if piece := text[start:end].strip():
            out.append(piece)
        start = _resume(text, start, end, overlap)
    return out


def split_markdown(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Chunks of each section's body, with the path of headings in front."""
    path: list[str] = []
    sections: list[tuple[str, list[str]]] = [("", [])]
    for line in (text or "").splitlines():
        if m := re.match(r"^(#{1,6})\s+(.+?)\s*$", line):
            depth = len(m[1]) - 1
            path = [*path[:depth], *[""] * (depth - len(path)), m[2].strip()]
            sections.append((" > ".join(h for h in path if h), []))
        else:
            sections[-1][1].append(line)
    out = []
    for where, lines in sections:
        head = f"文档位置：{where}" if where else ""
        body = "\n".join(lines).strip()
        out += [f"{head}\n\n{c}" if head else c for c in split_text(body, max(200, size - len(head) - 2), overlap)]
    return out


def chunks(docs: DataFrame, how: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, idx, content) of documents (doc_id, text); ``how``: fixed, text or markdown."""
    if how == "fixed":
        parts = fixed_windows(F.col("text"), size, overlap)
    else:
        split = {"text": split_text, "markdown": split_markdown}[how]

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def cut(t: pd.Series) -> pd.Series:
            return t.map(lambda x: split(x, size, overlap))

        parts, docs = cut(F.col("text")), small_batches(docs)
    return docs.select("doc_id", F.posexplode(parts).alias("idx", "content"))
