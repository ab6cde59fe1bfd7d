"""The pipeline against the brute-force versions of its stages, one after the other."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_join import brute as brute_join
from test_native import brute_failed, brute_targets, brute_templates, words

import corpus_pipeline
from matchlight.llm import bpe_tree, fair_mix, host_rules, template_tree

P = pytest.importorskip("public_tokenizers")


def make_documents():
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 7))) for _ in range(n))
    shared = [prose(14) for _ in range(3)]
    rows = []
    for i in range(60):
        text = "\n".join([prose(rng.randint(12, 60)) for _ in range(3)] + rng.sample(shared, rng.randint(0, 2)))
        rows.append(text)
        if i % 5 == 0:
            rows.append(text)
        if i % 6 == 0:
            w = text.split(" ")
            w[3] = "changed"
            rows.append(" ".join(w))
    rows += [None, "", "too short", prose(20) * 4, "a b c d e f g h " * 30]
    rng.shuffle(rows)
    return [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(rows)]


def test_pipeline(spark, tmp_path):
    rows = make_documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    fails = defaultdict(list)
    for r in rows:
        fails[r[3]].append(brute_failed(r[1]))
    rates = [sum(v) / len(v) for v in fails.values()]
    mean = sum(rates) / len(rates)
    a, b = host_rules.prior(mean, sum((x - mean) ** 2 for x in rates) / len(rates))
    good = {h for h, v in fails.items() if (sum(v) + a) / (len(v) + a + b) < 0.5}
    at, kept = Counter(), []
    for r in rows:
        failed = fails[r[3]][at[r[3]]]
        at[r[3]] += 1
        if r[3] in good and not failed:
            kept.append(r)

    places = defaultdict(list)
    for r in kept:
        for p, line in enumerate(r[1].split("\n")):
            for t in brute_templates(line) if words(line) else ():
                places[t].append((r[0], p))
    drop = {x for v in places.values() if len({i for i, _ in v}) >= template_tree.MIN_DOCS for x in v if x != min(v)}
    cleaned = []
    for r in kept:
        lines = r[1].split("\n")
        left = [line for p, line in enumerate(lines) if (r[0], p) not in drop]
        if any(words(line) for line in left):
            cleaned.append((r[0], "\n".join(left), r[3]))
    assert drop and len(cleaned) <= len(kept)

    classes = brute_join([t for _, t, _ in cleaned])
    single = [x for k, x in enumerate(cleaned) if classes[k][0] == k]
    assert len(single) < len(cleaned)

    u = {r["id"]: r["u"] for r in spark.range(len(rows)).select("id", fair_mix.place(F.col("id")).alias("u")).collect()}
    sums = Counter()
    for _, t, s in single:
        sums[s] += len(words(t))
    targets, queue = brute_targets(sums), []
    for s in sums:
        run = 0
        for e in (0, 1):
            for i, t, _ in sorted((x for x in single if x[2] == s), key=lambda x: u[x[0]]):
                run += len(words(t))
                queue.append((run / targets[s], "" if s is None else "=" + s, e, u[i], i, t))
    total, taken = 0, []
    for x in sorted(queue):
        total += len(words(x[5]))
        if total > int(1.5 * sum(sums.values())):
            break
        taken.append((x[4], x[5]))

    encode, _ = bpe_tree.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    want = Counter()
    for i, t in taken:
        ids = encode(t)
        want[(i, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out) == want


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    rows = make_documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
