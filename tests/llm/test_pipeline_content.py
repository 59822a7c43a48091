"""Each stage of the pipeline against a plain version of it, on the stage's own input; odd rows; what stays behind."""

import os
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from postwatch.llm import langid, linededup
from postwatch.llm.registry import ship, table
from postwatch.session import keep, shared_folder
from tests.llm.test_queries import near_groups, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage, as rows by id; the last output is a list."""
    import corpus_pipeline as P

    ship(spark)
    frame = table(spark, SF, "documents")
    out = {}
    for name, stage in P.STAGES:
        given = {r["doc_id"]: r.asDict() for r in frame.collect()}
        frame = keep(stage(spark, frame, SF), name)
        rows = [r.asDict() for r in frame.collect()]
        out[name] = (given, rows if name == "mixing" else {r["doc_id"]: r for r in rows})
        assert name == "mixing" or len(out[name][1]) == len(rows)
    return out


def test_language_id(stages):
    import corpus_pipeline as P

    given, got = stages["language_id"]
    labels = sorted({r["lang"] for r in given.values() if r["lang"] is not None and r["text"] is not None})
    grams, letters = np.zeros((langid.BUCKETS, len(labels))), np.zeros((len(langid.SCRIPT_NAMES), len(labels)))
    for r in given.values():
        if r["lang"] is not None and r["text"] is not None:
            w, k = langid.cut([r["text"]]), labels.index(r["lang"])
            np.add.at(grams[:, k], w.trigrams, 1)
            np.add.at(letters[:, k], w.script, w.end - w.start)
    model = langid.model_of(labels, grams, letters)
    want = set()
    for d, r in given.items():
        w = langid.cut([r["text"] or ""])
        if not len(w.first):
            continue
        # The best path word by word.
        scores, value, back = langid.word_scores(w, model), None, []
        for s in scores.astype(float):
            if value is None:
                value = s
                continue
            top = int(value.argmax())
            stay = value >= value[top] - langid.SWITCH
            back.append(np.where(stay, np.arange(len(labels)), top))
            value = np.where(stay, value, value[top] - langid.SWITCH) + s
        path = [int(value.argmax())]
        for came in reversed(back):
            path.append(int(came[path[-1]]))
        letters_of = Counter()
        for k, n in zip(reversed(path), w.end - w.start):
            letters_of[k] += int(n)
        if max(letters_of.values()) >= P.LEAST_SHARE * sum(letters_of.values()):
            want.add(d)
    assert set(got) == want and all(got[d] == given[d] for d in got)


def test_line_dedup(stages):
    given, got = stages["line_dedup"]
    lines = {d: [x.strip(linededup.BLANKS) for x in (r["text"] or "").split("\n")] for d, r in given.items()}
    earlier, seen = {}, set()
    for d in sorted(given):
        own = lines[d]
        full = tuple(x for x in own if x)
        if full in seen and sum(map(len, full)) >= linededup.MIN_CHARS:
            gone = {i for i, x in enumerate(own) if x}
        else:
            gone = set()
            for e in earlier.values():
                gone |= set(e.blocks(own, [len(x) for x in own], linededup.MIN_CHARS))
        seen.add(full)
        earlier[d] = linededup.Earlier(own, [len(x) for x in own])
        text = "\n".join(x for i, x in enumerate(given[d]["text"].split("\n")) if i not in gone)
        assert got[d] == given[d] | {"text": text, "n_chars": len(text)}, d
    assert set(got) == set(given)


def test_near_duplicates(stages):
    given, got = stages["simhash"]
    groups = near_groups({d: simhash(r["text"] or "") for d, r in given.items()})
    assert set(got) == set(groups.values()) and len(got) < len(given)
    assert all(got[d] == given[d] for d in got)


def test_decontamination(stages):
    given, got = stages["decontamination"]

    def words(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]

    windows = set()
    for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist():
        w = words(r["text"])
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n}
    sizes = {len(w) for w in windows}
    want = set()
    for d, r in given.items():
        w = words(r["text"])
        if not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1)):
            want.add(d)
    assert set(got) == want and all(got[d] == given[d] for d in got) and 0 < len(got) < len(given)


def test_mixing(stages):
    from postwatch.llm.mixing import targets

    given, rows = stages["mixing"]
    size = {d: len((r["text"] or "").encode().split()) for d, r in given.items()}
    sources, taken = Counter(), Counter()
    for d, r in given.items():
        sources[r["source"]] += size[d]
    for r in rows:
        assert {k: r[k] for k in given[r["doc_id"]]} == given[r["doc_id"]]
        taken[r["source"]] += size[r["doc_id"]]
    goal, most = targets(dict(sources)), max(size.values())
    assert all(abs(taken[s] - goal[s]) <= most for s in goal)
    assert max(Counter(r["doc_id"] for r in rows).values()) <= 2


def test_odd_tables(spark, tmp_path):
    import corpus_pipeline as P

    ship(spark)
    real = spark.read.parquet(f"{SF}/documents.parquet")
    kinds = {f.name: f.dataType for f in real.schema.fields}
    long = " ".join(f"word{i}" for i in range(20_000))
    rows = [(1, None, "en", "a"), (2, "", None, None), (None, "the nameless text of the house", "en", "a"), (3, "the river and the house", "en", "a"),
            (3, "the river and the house", "en", "a"), (4, long, "en", "b"), (5, long, None, "b"), (6, " \n ", "en", "b")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").select(
        "doc_id", "text", "lang", "source", F.length("text").cast(kinds["n_chars"]).alias("n_chars"),
        *(F.lit(i).alias(c) for i, c in enumerate(["th", "score", "lang_pred", "n_hit", "component_id", "shard", "draws"])),
    )
    for name, frame in (("odd", odd), ("none", odd.limit(0))):
        folder = str(tmp_path / name)
        frame.write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
        before = set(os.listdir(shared_folder(spark)))
        got = P.run(spark, folder)
        assert set(odd.columns) <= set(got.columns)
        ids = {r["doc_id"] for r in got.collect()}
        assert ids <= {None, 3, 4, 5} and (name == "none") == (not ids)
        left = {f.rsplit("-", 1)[0] for f in set(os.listdir(shared_folder(spark))) - before}
        assert not left & {"language_id", "line_dedup", "simhash", "lines", "spans"}
