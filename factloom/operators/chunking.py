"""Chunking of whole texts by packing: parents of PARENT characters, children of CHILD within each.

Packing is a fold over a text's lines, so it runs as a small helper on one text at a time inside Arrow batches; texts are
spread by Spark and never gathered.  Null and blank texts give no chunks; a line longer than the target is cut in
windows that overlap.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as tx

#: Characters of a chunk cut under its running title, and of its overlap.
TITLED, TITLED_OVERLAP = 900, 120
PARENT, PARENT_OVERLAP, CHILD, CHILD_OVERLAP, CHILD_LEAST = 1050, 120, 360, 40, 120


def windows(text: str, size: int, overlap: int) -> list[str]:
    """Windows of `size` characters, each starting `overlap` before the last one's end; the last reaches the end."""
    if len(text) <= size:
        return [text]
    count = -(-(len(text) - size) // (size - overlap)) + 1
    return [w for i in range(count) if (w := text[i * (size - overlap) : i * (size - overlap) + size].strip())]


def pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Pieces joined while they fit `size`; each further chunk opens with the tail of the one before."""
    out: list[str] = []
    for piece in (w for p in pieces for w in windows(p, size, overlap)):
        if out and len(out[-1]) + 1 + len(piece) <= size:
            out[-1] += "\n" + piece
        else:
            tail = out[-1][-overlap:].strip() if out and overlap else ""
            out.append(f"{tail}\n{piece}" if tail else piece)
    return out


def join_short(chunks: list[str], size: int, least: int) -> list[str]:
    """Short chunks join their neighbour before them, if the two stay within 1.15 times the target."""
    out: list[str] = []
    for c in chunks:
        if out and (len(c) < least or len(out[-1]) < least) and len(out[-1]) + 1 + len(c) <= int(size * 1.15):
            out[-1] += "\n" + c
        else:
            out.append(c)
    return out


def parent_child(documents: DataFrame) -> DataFrame:
    """`doc_id`, `parent_idx`, `child_idx`, `text` of every child."""
    rows = documents.where(F.col("text").rlike(r"\S")).select("doc_id", tx.normalize(F.col("text")).alias("t"))

    def cut(batches):
        for b in batches:
            out = []
            for d, t in zip(b["doc_id"], b["t"], strict=True):
                for i, parent in enumerate(pack(t.split("\n"), PARENT, PARENT_OVERLAP)):
                    out += [(d, i, j, c) for j, c in enumerate(join_short(pack(parent.split("\n"), CHILD, CHILD_OVERLAP), CHILD, CHILD_LEAST))]
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "parent_idx", "child_idx", "text"])

    return rows.mapInPandas(cut, "doc_id bigint, parent_idx int, child_idx int, text string")


def title_aware(documents: DataFrame) -> DataFrame:
    """`doc_id`, `section_idx`, `title`, `chunk_idx`, `text`: chunks that never cross a title line; null before the first one."""
    ls = tx.lines(tx.normalize(F.col("text")))
    rows = documents.where(F.col("text").rlike(r"\S")).select("doc_id", ls.alias("ls"), F.transform(ls, tx.is_title_like).alias("ts"))

    def cut(batches):
        for b in batches:
            out = []
            for d, ls, ts in zip(b["doc_id"], b["ls"], b["ts"], strict=True):
                starts = [0, *(i for i, t in enumerate(ts) if t and i)]
                for n, (i, j) in enumerate(zip(starts, [*starts[1:], len(ls)], strict=True)):
                    out += [(d, n, ls[i] if ts[i] else None, k, c) for k, c in enumerate(pack(list(ls[i:j]), TITLED, TITLED_OVERLAP))]
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "section_idx", "title", "chunk_idx", "text"])

    return rows.mapInPandas(cut, "doc_id bigint, section_idx int, title string, chunk_idx int, text string")
