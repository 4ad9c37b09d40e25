"""URL filters: rules in a sorted, memory-mapped array of 64-bit digests.

A rule is a host and a path prefix that ends with a slash, such as
``example.net/en/``. It fits its host and all subdomains if the path of the url
starts with its path; of several that fit, the longest decides, at equal length
the one with the longer host. The digests (xxhash64 of the whole rule) are
written once, in order, with the rules' full strings beside them. Every
executor maps the file; a batch of urls probes it with one vectorised binary
search, and equal digests are confirmed on the stored strings.

A missing url, or one without ``://``, has an empty host and path and fits no
rule. Repeated rows are judged each. Only ``page_id`` and ``url`` are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from grainmill.session import new_folder

MAX_BYTES = 1 << 30
HEAD = struct.Struct("<QQ")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), path


def digest_array(rules: dict[str, str]) -> bytes:
    """The file: number of rules and bytes of text, digests in order, ends of the texts, texts.

    A stored text is the verdict's first letter and the rule.
    """
    rows = []
    for rule, verdict in rules.items():
        if verdict not in ("allow", "block") or "/" not in rule or not rule.endswith("/"):
            raise ValueError(f"not a rule: {verdict} {rule}")
        rows.append((xxhash.xxh64_intdigest(rule), (verdict[0] + rule).encode()))
    rows.sort()
    keys = np.array([k for k, _ in rows], "<u8")
    ends = np.cumsum([len(t) for _, t in rows], dtype="<u8").astype("<u8")
    texts = b"".join(t for _, t in rows)
    data = HEAD.pack(len(rows), len(texts)) + keys.tobytes() + ends.tobytes() + texts
    if len(data) > MAX_BYTES:
        raise ValueError(f"{len(data)} bytes of rules; {MAX_BYTES} are sent to the executors at most")
    return data


class DigestArray:
    """The mapped file; nothing of it is copied."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        self.size, length = HEAD.unpack(data[: HEAD.size].tobytes())
        keys_end = HEAD.size + 8 * self.size
        self.keys = data[HEAD.size : keys_end].view("<u8")
        self.ends = data[keys_end : keys_end + 8 * self.size].view("<u8")
        self.texts = data[keys_end + 8 * self.size :][:length]

    def _text(self, at: int) -> bytes:
        return self.texts[int(self.ends[at - 1]) if at else 0 : int(self.ends[at])].tobytes()

    def probe(self, rules: list[str]) -> dict[int, str]:
        """Place of each given rule that is stored, with its verdict."""
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, rules), np.uint64, len(rules))
        at = np.searchsorted(self.keys, wanted)
        inside = at < self.size
        met = np.flatnonzero(inside)[self.keys[at[inside]] == wanted[inside]]
        found = {}
        for k in met:
            place = int(at[k])
            while place < self.size and self.keys[place] == wanted[k]:
                text = self._text(place)
                if text[1:] == rules[k].encode("utf-8", "surrogatepass"):
                    found[int(k)] = "allow" if text[:1] == b"a" else "block"
                place += 1
        return found


def _send(spark: SparkSession, data: bytes) -> str:
    """Write a file to the shared folder and have Spark bring it to each executor."""
    path = f"{new_folder(spark, 'rules')}.bin"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    try:
        for k in range(0, len(data), 1 << 20):
            stream.write(bytearray(data[k : k + (1 << 20)]))
    finally:
        stream.close()
    name = f"rules-{xxhash.xxh64_hexdigest(path)}.bin"
    renamed = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), name)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).rename(place, renamed)
    spark.sparkContext.addFile(renamed.toString())
    return name


def filter_urls(pages: DataFrame, rules: dict[str, str], otherwise: str = "allow") -> DataFrame:
    """Per row: page_id, host, path, rule (NULL if none fits) and verdict.

    ``rules`` gives the verdict, allow or block, of each; together they may take
    MAX_BYTES. ``otherwise`` is the verdict where no rule fits.
    """
    name = _send(pages.sparkSession, digest_array(rules))
    kind = pages.schema["page_id"].dataType.simpleString()
    # Only hosts and paths of as many parts as some rule has can fit.
    levels = {r.split("/", 1)[0].count(".") + 1 for r in rules}
    depths = {r.count("/") for r in rules}

    def candidates(host: str, path: str) -> list[str]:
        labels = host.split(".")
        hosts = [".".join(labels[-n:]) for n in levels if n <= len(labels)]
        paths, at = [], -1
        for depth in range(1, max(depths, default=0) + 1):
            at = path.find("/", at + 1)
            if at < 0:
                break
            if depth in depths:
                paths.append(path[: at + 1])
        return [h + p for h in hosts for p in paths]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        array = DigestArray(SparkFiles.get(name))
        for batch in batches:
            parts = [split_url(u) for u in batch["url"]]
            probes, owner = [], []
            for k, (host, path) in enumerate(parts):
                if host and path.startswith("/"):
                    for rule in candidates(host, path):
                        probes.append(rule)
                        owner.append(k)
            best: dict[int, tuple[int, int, str, str]] = {}
            for k, verdict in array.probe(probes).items():
                rule = probes[k]
                rank = (len(rule), rule.index("/"), rule, verdict)
                best[owner[k]] = max(best.get(owner[k], rank), rank)
            yield pd.DataFrame(
                {
                    "page_id": batch["page_id"],
                    "host": [p[0] for p in parts],
                    "path": [p[1] for p in parts],
                    "rule": [best[k][2] if k in best else None for k in range(len(parts))],
                    "verdict": [best[k][3] if k in best else otherwise for k in range(len(parts))],
                }
            )

    schema = f"page_id {kind}, host string, path string, rule string, verdict string"
    return pages.select("page_id", "url").mapInPandas(judge, schema)
