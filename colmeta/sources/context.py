"""Context documents: their text, and a table's context of all of them."""

from __future__ import annotations

import codecs
import hashlib
import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colmeta.functions.predicates import stripped
from colmeta.functions.text import CONTEXT_CHARS, plain_html, prompt

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """Paragraphs of a .docx file, one a line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in root.iter(f"{_WORD}p"))


#: Extractors by file suffix. A caller may add others, such as one for .pdf.
EXTRACTORS: dict[str, Callable[[bytes], str]] = {".docx": docx_text, ".txt": lambda c: c.decode("utf-8", "replace")}


def document_texts(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """name, text of files (path, content); a suffix without extractor gives the empty text."""
    by_suffix = EXTRACTORS | (extractors or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [next((f for s, f in by_suffix.items() if p.lower().endswith(s)), None) for p in b["path"]]
            yield pd.DataFrame({"name": b["path"], "text": [f(c) if f else "" for f, c in zip(found, b["content"], strict=True)]})

    return files.select("path", "content").mapInPandas(run, "name string, text string")


def read_documents(spark: SparkSession, paths: str | list[str], extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """Texts of context files, as document_texts() gives them."""
    return document_texts(spark.read.format("binaryFile").load(paths), extractors)


def page_texts(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with the text of their html, as a context takes it."""
    return pages.withColumn("text", plain_html(F.col(html)))


def assembled(documents: DataFrame, by: tuple[str, ...] = ("table_id",), order: str = "seq", text: str = "text") -> DataFrame:
    """The context of each table: its documents' trimmed texts in order, a line end after each."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.trim(text).alias("t")))), lambda x: F.concat(x["t"], F.lit("\n")))
    return documents.groupBy(*by).agg(F.array_join(ordered, "").alias("context"))


#: Bytes of a document that are one row of the stream of streamed_requests().
PIECE = 4096
_WHITE = b" \t\n\v\f\r"


class _Feed:
    """One table's context as it passes: the cache key of each request, and the context's first characters."""

    def __init__(self) -> None:
        self.asked: list[tuple[str | None, list[str] | None, str]] = []
        self.whole: list = []  # digests of all that has passed since the first character that is no white space
        self.inner: list = []  # and of all up to the last such character
        self.begun, self.head, self.chars = False, [], 0
        self.decode = codecs.getincrementaldecoder("utf-8")("replace").decode

    def ask(self, provider: str | None, variables: list[str] | None, own: str, names: str) -> None:
        self.asked.append((provider, variables, names))
        self.whole.append(hashlib.sha256(f"{own}|".encode()))
        self.inner.append(self.whole[-1].copy())

    def add(self, data: bytes) -> None:
        if self.chars < CONTEXT_CHARS:
            self.head.append(self.decode(data))
            self.chars += len(self.head[-1])
        if not self.begun:
            data = data.lstrip(_WHITE)
            self.begun = bool(data)
        text = data.rstrip(_WHITE)
        for i, h in enumerate(self.whole):
            if text:
                h.update(text)
                self.inner[i] = h.copy()
            h.update(data[len(text) :])

    def rows(self) -> Iterator[tuple[str | None, list[str] | None, str, str]]:
        head = "".join(self.head)[:CONTEXT_CHARS]
        for (provider, variables, names), h in zip(self.asked, self.inner, strict=True):
            h.update(f"|{names}".encode())
            yield provider, variables, head, h.hexdigest()


def streamed_requests(documents: DataFrame, asked: DataFrame, by: tuple[str, ...] = ("table_id",), order: str = "seq", text: str = "text") -> DataFrame:
    """The requests that answers.requests() makes of assembled() contexts, without a context ever being one text.

    documents: by, order, text; asked: by, provider, variables. A table's documents pass in order through one task, piece by
    piece, into a running SHA-256 for each of its requests; only the context's first CONTEXT_CHARS characters, all that a
    prompt holds, are copied. So a context may be larger than memory, where a document may not. Returns by, provider,
    context (these first characters), variables, cache_key, prompt. Documents without text are left out, those of one place
    come by their first PIECE bytes; a table without documents has an empty context.
    """
    keys, n = list(by), len(by)
    raw = F.trim(F.col(text)).cast("binary")
    cut = F.transform(F.array(raw), lambda b: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length(b) / PIECE), F.lit(1)).cast("int") - 1), lambda i: F.substring(b, i * PIECE + 1, F.lit(PIECE))))[0]
    rows = documents.where(F.col(text).isNotNull()).select(*keys, F.col(order).alias("__seq"), F.monotonically_increasing_id().alias("__doc"), cut.alias("__cut"))
    pieces = rows.select(*keys, F.lit(1).alias("__kind"), "__seq", F.col("__cut")[0].alias("__head"), "__doc", F.size("__cut").alias("__n"), F.posexplode("__cut").alias("__at", "__data"))
    names = F.coalesce(F.array_join("variables", ","), F.lit(""))
    asks = asked.select(*keys, F.lit(0).alias("__kind"), "provider", "variables", F.coalesce(stripped(F.col("provider")), F.lit("")).alias("__own"), names.alias("__names"))
    stream = pieces.unionByName(asks, allowMissingColumns=True).repartition(*keys)
    stream = stream.sortWithinPartitions(*keys, "__kind", F.col("__seq").asc_nulls_first(), "__head", "__doc", "__at")
    stream = stream.select(*keys, "__kind", "__at", "__n", "__data", "provider", "variables", "__own", "__names")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, feed = None, _Feed()

        def out(key: tuple, feed: _Feed) -> Iterator[pa.RecordBatch]:
            for provider, variables, head, digest in feed.rows():
                values = [*key, provider, head, variables, digest]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        schema = None
        for b in batches:
            if schema is None:
                schema = pa.schema([*(b.schema.field(i) for i in range(n)), ("provider", pa.string()), ("context", pa.string()), ("variables", pa.list_(pa.string())), ("cache_key", pa.string())])
            for i in range(b.num_rows):
                row = [c[i].as_py() for c in b.columns]
                key, (kind, at, parts, data, provider, variables, own, sent) = tuple(row[:n]), row[n:]
                if key != now:
                    if now is not None:
                        yield from out(now, feed)
                    now, feed = key, _Feed()
                if kind == 0:
                    feed.ask(provider, variables, own, sent)
                elif feed.asked:
                    feed.add(data + b"\n" if at == parts - 1 else data)
        if now is not None:
            yield from out(now, feed)

    types = dict(asked.dtypes)
    found = stream.mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", provider string, context string, variables array<string>, cache_key string")
    return found.withColumn("prompt", prompt(F.col("context"), F.col("variables")))
