"""Writing tables: once, appended, or resumed where an earlier write stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosswalk.functions.names import safe_filename

REVIEWED = ("accepted", "changed", "rejected")


def write_guarded(matrix: DataFrame, old: DataFrame | None, path: str, force: bool = False) -> None:
    """Writes a matrix anew; refused while the old one holds review decisions, unless forced, which keeps the old rows beside it."""
    if old is not None:
        n = old.where(F.col("reviewStatus").isin(*REVIEWED)).count()
        if n and not force:
            raise ValueError(f"{n} reviewed decisions would be lost")
        if n:
            old.write.mode("errorifexists").parquet(f"{path}.backup")
    matrix.write.mode("overwrite").parquet(path)


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a log."""
    rows.write.mode("append").parquet(path)


def resume(rows: DataFrame, done: DataFrame | None, key: str, path: str) -> int:
    """Appends the rows whose key isn't evaluated yet; how many these were."""
    left = rows if done is None else rows.join(done.where("status = 'evaluated'").select(key).distinct(), key, "left_anti")
    left = left.persist()
    try:
        n = left.count()
        if n:
            left.write.mode("append").parquet(path)
        return n
    finally:
        left.unpersist()


def file_names(rows: DataFrame, name: str) -> DataFrame:
    """Adds file: the name without forbidden characters, and a hash of the name where names meet in any case."""
    safe = safe_filename(F.col(name))
    w = Window.partitionBy(F.lower(safe))
    return rows.withColumn("file", F.when(F.count("*").over(w) > 1, F.concat(safe, F.lit("-"), F.substring(F.sha2(F.col(name).cast("binary"), 256), 1, 16))).otherwise(safe))


def documents(rows: DataFrame, path: str) -> None:
    """JSON documents, a row a line, in files that a commit makes visible together."""
    rows.write.mode("errorifexists").json(path)


def put(path: str, data: bytes) -> None:
    """Writes a whole file under its name at once: to another name first, then moved. A name without a scheme, or with that of files, is local."""
    import os
    import re
    import uuid
    from urllib.parse import urlparse

    u = urlparse(path)
    if u.scheme in ("", "file"):
        part = f"{u.path}.{uuid.uuid4().hex}.part"
        os.makedirs(os.path.dirname(u.path), exist_ok=True)
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, u.path)
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))
    part = f"{at}.{uuid.uuid4().hex}.part"
    store.create_dir(os.path.dirname(at), recursive=True)
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, at)


def single_documents(rows: DataFrame, folder: str) -> int:
    """Writes each row (file, text), a JSON document, as one file of its name with two spaces to a level and a line end; how many. A file is there whole or not at all.

    A text that is no JSON is an error. Of rows of one file name the last written stays, so names must be distinct (:func:`file_names` makes them so).
    """
    import json
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, text in zip(pdf["file"], pdf["text"], strict=True):
                put(f"{folder.rstrip('/')}/{name}", (json.dumps(json.loads(text), indent=2, ensure_ascii=False) + "\n").encode("utf-8"))
            yield pd.DataFrame({"n": [len(pdf)]})

    return rows.select("file", "text").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0
