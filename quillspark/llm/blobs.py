"""Binary files written by Spark's own committer and read by its binary reader.

A binary column is written through the text sink as raw bytes, so files appear only when a
task commits, in any store Spark can reach, and a lost executor's half-written file never
does. Each row of bytes is followed by one line feed, which the formats here allow for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Blobs in a file; writers make blobs of some megabytes each, so files stay within 64 MB or so.
FILE_BLOBS = 8


def write_blobs(df: DataFrame, column: str, path: str, folder: str | None = None) -> None:
    """``folder``: a column whose value names the folder that a row goes to. A task's files are
    numbered in the order of its rows."""
    more = [folder] if folder else []
    df.select(F.col(column).cast("string").alias("value"), *more).write.partitionBy(*more).option("lineSep", "\n").option("maxRecordsPerFile", FILE_BLOBS).text(path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files, whose sizes are bounded when they are written."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")


class Files:
    """Reads parts of files in any store that Spark reaches, by seeks; for lookups on the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(self.conf)
        self.n_read = 0

    def sizes(self) -> dict[str, int]:
        """Length of each file under the path."""
        out, it = {}, self.fs.listFiles(self.path, True)
        while it.hasNext():
            f = it.next()
            if f.getPath().getName().startswith("part-"):
                out[f.getPath().toString()] = f.getLen()
        return out

    def read(self, name: str, at: int, n: int) -> bytes:
        self.n_read += n
        stream = self.fs.open(self.jvm.org.apache.hadoop.fs.Path(name))
        try:
            stream.seek(at)
            return bytes(stream.readNBytes(n))
        finally:
            stream.close()
