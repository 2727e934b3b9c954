"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unicode White_Space, as the tokenizers' regular expressions understand ``\s``.
WHITE = "\t-\r \x85\xa0  -     　"
_SPLIT = re.compile(f"[{WHITE}]+")
_CONTROL = re.compile("[\x1c-\x1f]")


#: So many texts of a batch are Python objects at a time.
SLICE = 256


def chunks(text: str) -> list[str]:
    """The white-space separated chunks of a text, by Unicode White_Space only."""
    if _CONTROL.search(text):  # str.split() also breaks at these four
        return [x for x in _SPLIT.split(text) if x]
    return text.split()


def ascii_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What stands between the ASCII white space of all texts, one after the other, and where each text's begins; the last place is the end."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), before[offsets]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that are no columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def id_remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as decimal text, modulo ``mod``; a null id counts as the empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % mod


def map_text(df: DataFrame, id_col: str, text_col: str, schema: str, make: Callable[[], Callable[[object, str | None], tuple]]) -> DataFrame:
    """One output row for each input row, through Arrow.

    ``make`` runs once in each task and gives the function of (id, text); its
    tuples follow ``schema``.  Rows without a text get None.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), SLICE):
                part = texts.slice(at, SLICE).to_pylist()
                rows = [fn(i, t) for i, t in zip(ids[at : at + SLICE], part, strict=True)]
                yield record_batch(rows, names, types)

    out = df.sparkSession.createDataFrame([], schema).schema
    names = out.names
    types = _arrow_types(out)
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, out)


def _arrow_types(schema) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).types


def record_batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see.

    It lies in the folder the cluster names in ``spark.checkpoint.dir``.  Only
    where that is unset, as in local tests, a folder of this machine is used.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "part", base: str | None = None) -> DataFrame:
    """The rows of ``df``, computed once: written as Parquet to the shared folder and read again.

    The files outlive lost executors, and the plan that follows starts from them.
    """
    path = f"{base or shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
