"""The pipeline's near-duplicate stage against all pairs, by the exact similarity of five-word shingles."""

import random

import corpus_pipeline
import pytest

from porelake.llm import quality, similar
from porelake.llm.graph import Forest

SF = "/root/testdata/sf0.001"


def brute(rows):
    """The ids that stay: the smallest of what pairs of similarity 0.8 or more connect."""
    sets = [set(zip(*(r.text.lower().split()[i:] for i in range(5)))) for r in rows]
    forest = Forest()
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                forest.union(rows[i].doc_id, rows[j].doc_id)
    return sorted(r.doc_id for r in rows if forest.find(r.doc_id) == r.doc_id)


def test_stage_against_all_pairs(spark):
    from porelake.llm.common import staged

    docs = staged(quality.good_documents(spark.read.parquet(f"{SF}/documents.parquet")))
    out = corpus_pipeline.simhash_near_dedup(spark, docs, SF)
    assert out.dtypes == docs.dtypes
    assert sorted(r.doc_id for r in out.collect()) == brute(docs.select("doc_id", "text").collect())


@pytest.mark.parametrize("part_size", [7, 512])
def test_chains_of_copies_and_parts_of_buckets(spark, part_size):
    rng = random.Random(5)
    texts = []
    for _ in range(6):
        words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        for _ in range(25):
            words = list(words)
            for at in rng.sample(range(150), rng.choice((1, 2, 3, 6))):
                words[at] = f"w{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = similar.first_of_each_group(docs, part_size=part_size)
    assert sorted(r.doc_id for r in got.collect()) == brute(docs.collect())


def test_stage_goes_by_fingerprints_and_trees(spark):
    """The stage's candidates are fingerprints within the radius: with radius 0 near copies stay, by default none does."""
    from pyspark.sql import functions as F

    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:at] + ["new"] + base[at + 1 :]) for at in (20, 60, 100, 140)] + [" ".join(base)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in similar.first_of_each_group(docs).collect()] == [0]
    assert sorted(r.doc_id for r in similar.first_of_each_group(docs, radius=0).collect()) == [0, 1, 2, 3, 4]
    got = similar.codes(docs, 5).select("doc_id", "fp").orderBy("doc_id").collect()
    assert len({r.fp for r in got}) == 5 and max((got[0].fp ^ r.fp).bit_count() for r in got) <= similar.RADIUS
    assert similar.codes(docs, 5).agg(F.count_if(F.col("fp") == 0)).first()[0] == 0


@pytest.mark.parametrize("across", [False, True])
def test_tree_links_against_all_pairs(across):
    rng = random.Random(9)
    fp = [rng.getrandbits(64) for _ in range(6)]
    fp = [c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(12))) for c in fp for _ in range(15)]
    probe, root = [rng.random() < 0.5 for _ in fp], [i - i % 2 for i in range(len(fp))]
    met = lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 10 and not (across and probe[i] == probe[j])
    pairs = [(i, j) for i in range(len(fp)) for j in range(i) if met(i, j) and (i + j) % 3]
    ends = []
    for links in (pairs, similar.tree_links(fp, root, probe, across, 10, lambda i, j: (i + j) % 3)):
        forest = Forest()
        assert set(map(tuple, map(sorted, links))) <= set(map(tuple, map(sorted, pairs)))
        for i, j in [*links, *((i, root[i]) for i in range(len(fp)))]:
            forest.union(i, j)
        ends.append([forest.find(i) for i in range(len(fp))])
    assert ends[0] == ends[1]
