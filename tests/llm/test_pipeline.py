"""The pipeline against a brute-force version on a small table."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from gleanery.llm import mixing, quality_rules
from gleanery.llm.queries import TOKENIZER
from tests.llm.test_minhash import family, shingles


def documents(spark, small, tmp_path):
    base = " ".join(f"b{i}" for i in range(150))
    table = spark.read.parquet(f"{small}/documents.parquet")
    more = [(5000 + i, t, l, s, len(t)) for i, (_, t, l, s) in enumerate(family(base, 30, 6, 3, 0))]
    table = table.unionByName(spark.createDataFrame(more, table.schema))
    table.write.parquet(str(tmp_path / "documents.parquet"))
    return spark.read.parquet(str(tmp_path / "documents.parquet"))


def test_stages_equal_brute_force(spark, small, tmp_path):
    docs = documents(spark, small, tmp_path)
    rows = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in P.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "bpe"]

    # 1. Rules, one by one on every text.
    text = F.coalesce("text", F.lit(""))
    flags = docs.select("doc_id", *[r.reject.alias(r.name) for r in [*quality_rules.base_rules(text), *quality_rules.further_rules(text)]])
    good = sorted(r.doc_id for r in flags.collect() if not any(r[c] for c in flags.columns[1:]))
    # 2. and 3. First of equal texts, then of components of similar ones.
    seen, exact = set(), []
    for i in good:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", rows[i].text)
        if key not in seen:
            seen.add(key)
            exact.append(i)
    sets = {i: shingles(rows[i].text, 5) for i in exact}
    part = {i: i for i in exact}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for n, i in enumerate(exact):
        for j in exact[:n]:
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                part[b] = a
    near = [i for i in exact if root(i) == i]
    assert len(near) < len(exact) < len(good) < len(rows)
    # 4. and 5. The mix of those, and the library's ids.
    kept = docs.filter(F.col("doc_id").isin(near))
    copies = {r.doc_id: r.copies for r in mixing.mix(kept).collect()}
    library = Tokenizer.from_file(TOKENIZER)
    want = []
    for i, n in copies.items():
        ids = library.encode(rows[i].text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        raw = np.array(ids, dtype="<u4").tobytes()
        want += [(i, len(ids), raw, hashlib.sha256(decoded.encode()).hexdigest())] * n
    got = P.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "token_ids", "decoded_sha256").collect()
    assert sorted((r[0], r[1], bytes(r[2]), r[3]) for r in got) == sorted(want)


def test_stages_keep_columns_and_bear_an_empty_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        out = stage(spark, docs, small)
        assert out.count() == 0
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
