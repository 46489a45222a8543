"""The manifest against a tree built by hand."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from obsweave.llm import merkle
from obsweave.llm.common import lower_ascii

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, position string, grp string, total string, _salt string, path string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(digests):
    """The root over digests, and the siblings (left, right) of each on the way."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for i, place in enumerate(at):
            run = place // 8 * 8
            paths[i].append(("".join(level[run:place]), "".join(level[place + 1 : run + 8])))
            at[i] = place // 8
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
    return level[0], paths


def by_hand(rows, changed):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for lang in langs:
        order = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = (order, *climb([leaf(r) for r in order]))
    root, tops = climb([trees[lang][1] for lang in langs])
    found = []
    for lang, top in zip(langs, tops):
        order, subroot, paths = trees[lang]
        for row, path in zip(order, paths):
            way, digest = path + top, leaf(changed(row))
            for left, right in way:
                digest = sha(left + digest + right)
            found.append((row[0], leaf(row), subroot, root, sha("".join(a + b for a, b in way)), digest, digest == root))
    return sorted(found, key=str)


def altered(row):
    if row[0] is None or zlib.crc32(str(row[0]).encode()) % 3 or row[4] is None:
        return row
    return (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))


def of_spark(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)
    text = F.col("text")
    received = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lower_ascii(text)).otherwise(text)
    proven = merkle.manifest(docs, FIELDS, "lang", "doc_id", {"text": received})
    hexed = [merkle.hex_text(F.col(c)) for c in ("leaf", "subroot", "root")]
    proof = F.sha2(merkle.hex_text(merkle.proof_digests(F.col("path"))), 256)
    out = proven.select("id", *hexed, proof, merkle.hex_text(F.col("folded_root")), "verified")
    return sorted((tuple(r) for r in out.collect()), key=str)


MANY = [(i, "s", "de" if i % 5 else "fr", i, f"Text {i % 40} " + "Ö" * (i % 3)) for i in range(700)]
ODD = [
    (1, None, None, None, None), (2, "a", "", 0, ""), (3, "b", "ä", 5, "Ä A"), (4, "b", "z", 5, "no capitals"),
    (None, "c", "de", 1, "Null Id"), (None, "c", "de", 1, "Null Id"), (5, "c", "de", 1, "Twice"), (5, "c", "de", 1, "Twice"),
    (5, "c", "de", 1, "twice, but other"), (-7, "-", "-", -1, "-"), (6, "1:x", "2:de", 1, "W" * 300_000),
]


@pytest.mark.parametrize("rows", [MANY, ODD, ODD[:1], ODD[5:7], MANY[:9]], ids=["many", "odd", "one", "twice", "nine"])
def test_manifest_equals_the_tree_by_hand(spark, rows):
    assert of_spark(spark, rows) == by_hand(rows, altered)


def test_no_rows(spark):
    assert of_spark(spark, []) == []


def test_only_changed_texts_fail(spark):
    for id_, *_, verified in of_spark(spark, MANY[:50]):
        row = MANY[id_]
        assert verified == (altered(row) == row)
