"""What the operators of this subpackage share: table access, shared storage, text as bytes."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, new_path, shared_dir, ship  # noqa: F401


def prepare(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """The package on the executors, and batches for Python of so many rows and bytes at most unless the session says
    otherwise: texts can be long, and a worker holds a batch several times over."""
    ship(spark)
    for key, value in {"maxRecordsPerBatch": str(rows), "maxBytesPerBatch": size}.items():
        if f"spark.sql.execution.arrow.{key}" not in spark.conf.getAll:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns; whatever else the table holds stays out, so no name can clash."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *keep)


#: ASCII capitals to small letters, ASCII punctuation and control characters to spaces.
FOLD = bytes((c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32) for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words, lower-cased; ASCII punctuation and white space separate them."""
    return text.lower().encode("utf-8", "replace").translate(FOLD).split()


class Store:
    """Files in the shared folder, from driver or executor. A file is written under a name of its own and then renamed,
    so a task that runs twice leaves one whole file."""

    def __init__(self, root: str):
        self.root = root
        self.local = urlparse(root).path if urlparse(root).scheme in ("", "file") else None

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def write(self, name: str, parts) -> None:
        """parts: an iterable of bytes-like pieces, written as they come."""
        own = f"{name}.{uuid.uuid4().hex}.part"
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
            with open(f"{self.local}/{own}", "wb") as f:
                for x in parts:
                    f.write(x)
            os.replace(f"{self.local}/{own}", f"{self.local}/{name}")
            return
        fs, path = self._fs()
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/{own}") as f:
            for x in parts:
                f.write(x)
        fs.move(f"{path}/{own}", f"{path}/{name}")

    def open(self, name: str):
        if self.local is not None:
            return open(f"{self.local}/{name}", "rb")
        fs, path = self._fs()
        return fs.open_input_file(f"{path}/{name}")
