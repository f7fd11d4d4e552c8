"""The corpus pipeline stage by stage against plain versions of its decisions."""

import re

import brute
from harness import DATA

import corpus_pipeline
from tidemark.llm import common, decontaminate, toxicity

FOLDER = f"{DATA}/sf0.001"


def test_stages(spark):
    docs = common.load(spark, FOLDER, "documents")
    stages, rows = dict(corpus_pipeline.STAGES), {r.doc_id: r.text for r in docs.collect()}
    scored = {r.doc_id: r.score for r in toxicity.score_documents(docs, common.load(spark, FOLDER, "labels")).collect()}

    def after(name, before):
        out = common.durable(stages[name](spark, before, FOLDER))
        assert name == "packing" or out.columns == docs.columns
        return out, {r.doc_id for r in out.collect()}

    now, ids = after("toxicity", docs)
    assert ids == {i for i in rows if scored[i] < toxicity.THRESHOLD}

    now, kept = after("exact_dedup", now)
    first = {}
    for i in sorted(ids):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i] or ""), i)
    assert kept == set(first.values())

    now, ids = after("near_dedup", now)
    found = brute.components({i: brute.simhash(rows[i]) for i in kept})
    assert ids == {i for i in kept if found[i] == i}

    now, kept = after("decontamination", now)
    items = [common.hash_words([decontaminate.plain(r.text)])[0] for r in common.load(spark, FOLDER, "benchmark").collect()]
    leaks = set()
    for i in ids:
        words = common.hash_words([decontaminate.plain(rows[i])])[0]
        if any(len(w) and decontaminate.edits_within(w, words)[0] <= decontaminate.most_edits(len(w)) for w in items):
            leaks.add(i)
    assert kept == ids - leaks and leaks

    now, ids = after("packing", now)
    assert ids == kept
    assert {tuple(r)[:5] for r in now.collect()} == brute.pieces([(i, rows[i]) for i in kept])
