"""Results as files. Names follow from contents, so that a task that runs twice writes the same."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def writer(folder: str) -> Callable[[str, bytes], None]:
    """Writes files of a name into folder, any file system that pyarrow opens; it is made at the first of each."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    made: set[str] = set()

    def write(name: str, data: bytes) -> None:
        path = f"{root}/{name}"
        if (parent := path.rpartition("/")[0]) not in made:
            system.create_dir(parent, recursive=True)
            made.add(parent)
        with system.open_output_stream(path) as out:
            out.write(data)

    return write


def images(rows: DataFrame, folder: str) -> None:
    """rows: name, image. A file for each in folder."""

    def write(part: Iterable[Row]) -> None:
        save = writer(folder)
        for row in part:
            save(row.name, bytes(row.image))

    rows.select("name", "image").foreachPartition(write)


def results(markdown: DataFrame, items: DataFrame, pages: DataFrame, folder: str, documents: DataFrame | None = None) -> None:
    """Markdown, content list, pages and documents as JSON lines with their doc_id, in as many files as there are tasks and
    not one of each document."""
    markdown.select("doc_id", "markdown").write.mode("overwrite").json(f"{folder}/markdown")
    items.select("doc_id", "page_idx", "pos", F.to_json("item").alias("item")).write.mode("overwrite").json(f"{folder}/content_list")
    pages.write.mode("overwrite").json(f"{folder}/pages")
    if documents is not None:
        documents.write.mode("overwrite").json(f"{folder}/documents")
