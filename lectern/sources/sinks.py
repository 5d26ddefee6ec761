"""Sinks: packages, pieces of split files, joined audio."""

from __future__ import annotations

import io
import wave
import zipfile
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTAINER = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'


#: The style of all chapters.
CSS = "body { line-height: 1.6; } .-epub-media-overlay-active { background-color: #ffff99; }"


def package(members: Iterable[tuple[str, bytes]]) -> bytes:
    """A package as bytes: the type first and stored, the rest deflated."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype"), b"application/epub+zip", zipfile.ZIP_STORED)
        for name, data in [("META-INF/container.xml", CONTAINER.encode()), *members]:
            z.writestr(zipfile.ZipInfo(f"{name}"), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def packages(members: DataFrame) -> DataFrame:
    """members: book_id, name, data. book_id, epub: one package for each book, built where its members meet. A book is
    what one task can hold."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("name")
        return pd.DataFrame({"book_id": g["book_id"].iloc[:1], "epub": [package((f"OEBPS/{n}", bytes(d)) for n, d in zip(g["name"], g["data"], strict=True))]})

    kind = members.schema["book_id"].dataType.simpleString()
    return members.groupBy("book_id").applyInPandas(run, f"book_id {kind}, epub binary")


def pieces(lines: DataFrame) -> DataFrame:
    """lines: doc_id, file_no, line_no, line. A row for each piece: doc_id, file_no, name, value, blank lines at the end gone."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n")
    whole = lines.groupBy("doc_id", "file_no").agg(F.regexp_replace(joined, r"\n+$", "").alias("value"))
    return whole.withColumn("name", F.concat(F.col("doc_id").cast("string"), F.lit("_"), F.col("file_no").cast("string"), F.lit(".txt")))


def write_pieces(lines: DataFrame, path: str, split: bool = False) -> None:
    """Pieces as rows with their file's name, so that millions of pieces are a few files; on request (`split`) a folder for
    each document and file number, for books that people handle."""
    if split:
        pieces(lines).select("doc_id", "file_no", "value").write.partitionBy("doc_id", "file_no").text(path)
    else:
        pieces(lines).write.parquet(path)


def join_wav(parts: list[bytes]) -> bytes:
    """WAV pieces of one format as one; their frames follow each other."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        for i, p in enumerate(parts):
            with wave.open(io.BytesIO(p)) as r:
                if i == 0:
                    w.setparams(r.getparams())
                w.writeframes(r.readframes(r.getnframes()))
    return out.getvalue()


def joined_audio(pieces: DataFrame) -> DataFrame:
    """pieces: audio_id, n, wav. One WAV for each audio_id, pieces in order."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"audio_id": g["audio_id"].iloc[:1], "wav": [join_wav([bytes(x) for x in g.sort_values("n")["wav"]])]})

    return pieces.groupBy("audio_id").applyInPandas(run, "audio_id bigint, wav binary")
