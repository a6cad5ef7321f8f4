"""Small files of a Hadoop file system: read, list, and create once and whole."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from gaugeflow.session import hadoop_path

#: Schemes whose rename replaces nothing and is one step. Elsewhere (object stores) a rename is check and
#: copy, and two writers could both win it.
RENAMES = ("file", "hdfs", "viewfs")
#: Schemes whose create() can be told to fail if the object exists, checked by the store itself on close.
CONDITIONAL = {"s3a": "fs.option.create.conditional.overwrite", "abfs": None, "abfss": None, "gs": None}


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = hadoop_path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, but for hidden ones ('_' or '.' first); none if there is no such folder."""
    fs, p = hadoop_path(spark, path)
    if not fs.exists(p):
        return []
    return [n for n in (s.getPath().getName() for s in fs.listStatus(p)) if not n.startswith(("_", "."))]


def create_once(spark: SparkSession, path: str, text: str) -> None:
    """Create a file with the text, whole or not at all; FileExistsError if there is one.

    Where renaming is one step (RENAMES), a hidden file is written and renamed. On stores of CONDITIONAL the object is
    created on condition that there is none, which the store checks when it is closed. Any other scheme raises
    NotImplementedError: no claim of a commit is made where two writers could both win.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, to = hadoop_path(spark, path)
    scheme = fs.getUri().getScheme()
    if scheme not in RENAMES and scheme not in CONDITIONAL:
        raise NotImplementedError(f"no way is known to create a file once only on {scheme}://")
    to = fs.makeQualified(to)
    if scheme in CONDITIONAL:
        if fs.exists(to):
            raise FileExistsError(path)
        builder = fs.createFile(to).overwrite(False)
        if CONDITIONAL[scheme]:
            builder = builder.must(CONDITIONAL[scheme], True)
        try:
            out = builder.build()
            out.write(bytearray(text.encode()))
            out.close()
        except Exception as e:
            if not fs.exists(to):
                raise
            if read_text(spark, path) != text:
                raise FileExistsError(path) from e
        return  # written, or written although the store's answer was lost
    _, tmp = hadoop_path(spark, f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}")
    fs.mkdirs(to.getParent())
    out = fs.create(tmp, False)
    out.write(bytearray(text.encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    kinds = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(fs.makeQualified(tmp), to, kinds)
    except Exception as e:
        fs.delete(tmp, False)
        if fs.exists(to):
            raise FileExistsError(path) from e
        raise
