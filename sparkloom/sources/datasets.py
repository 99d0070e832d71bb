"""Public datasets by name."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkloom.frame import Frame
from sparkloom.sources import readers

_KINDS = {"raw": "warc", "text": "wet", "metadata": "wat", "warc": "warc", "wet": "wet", "wat": "wat"}


def common_crawl(spark: SparkSession, crawl: str, segment: str | None = None, content: str = "raw", num_files: int | None = None, root: str = "s3a://commoncrawl") -> Frame:
    """Records of a crawl, of one segment or all, as ``read_warc`` gives them; the crawl's own list names the
    files.  ``num_files`` takes the first of the list."""
    if content not in _KINDS:
        raise ValueError(f"content is one of {', '.join(_KINDS)}")
    named = spark.read.text(f"{root}/crawl-data/{crawl}/{_KINDS[content]}.paths.gz").where(F.trim("value") != "")
    if segment is not None:
        named = named.where(F.col("value").contains(f"/segments/{segment}/"))
    named = named.limit(num_files) if num_files is not None else named
    paths = [f"{root}/{r.value.strip()}" for r in named.toLocalIterator()]
    if not paths:
        raise ValueError(f"no {content} files of {crawl} {segment or ''}")
    return readers.read_warc(spark, paths)
