"""The subpackage's queries against brute force on the smallest tables."""

import hashlib
import math
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest
import xxhash

from postwatch.llm.queries import QUERIES, SQL
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


def read(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def rows(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, SF).collect()]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r["text"] or "" for r in read("documents")}


@pytest.mark.parametrize("name", list(SQL))
def test_sql(spark, name):
    ok, note = compare(spark, connect(SF), name, SF, QUERIES[name], SQL[name])
    assert ok, note


def test_lm_scoring(spark, docs):
    def low(t):
        return t.encode().lower().split()

    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in docs}
    counts = Counter(w for d, t in docs.items() if not held[d] for w in low(t))
    n_texts = sum(not h for h in held.values())
    total, kinds = sum(counts.values()) + n_texts, len(counts) + 1
    unit = math.log10(total + 0.1 * (kinds + 1))
    got = rows(spark, "op2_lm_scoring")
    assert len(got) == len(docs)
    for r in got:
        words = low(docs[r["doc_id"]])
        base = sum(math.log10(counts[w] + 0.1) for w in words) + math.log10(n_texts + 0.1) - (len(words) + 1) * unit
        assert r["held_out"] == held[r["doc_id"]] and r["n_tokens"] == len(words) + 1 and r["train_tokens"] == total
        assert r["n_known"] == sum(counts[w] > 0 for w in words) + 1
        assert r["base_score"] == pytest.approx(base)
    own = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own)


def test_chat(spark):
    said = "</s>[INST] ok [/INST]"
    turns = {-1: [("user", said), ("assistant", said)]}
    for r in sorted(read("conversations"), key=lambda r: (r["conv_id"], r["turn"])):
        turns.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    got = rows(spark, "op3_chat")
    assert {r["conv_id"] for r in got} == set(turns) and len(got) == len(turns)
    for r in got:
        own = turns[r["conv_id"]]
        loss = "".join(t for role, t in own if role == "assistant")
        assert r["n_turns"] == len(own) and r["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in own))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
        assert r["formatted_chars"] >= sum(len(t) for _, t in own)


def test_order_minhash(spark, docs):
    order = sorted(docs, reverse=True)
    got = {r["doc_id"]: r for r in rows(spark, "op4_order_minhash")}
    assert set(got) == set(docs)
    for d, after in zip(order, [*order[1:], order[0]]):
        text, third, r = docs[d], len(docs[d]) // 3, got[d]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == sha(text[: len(text) - third] + docs[after][:third])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if len(text) > 600 and docs[after] != text:
            assert r["near_edited"] > r["near_next"]
    by_text = {}
    for d, t in docs.items():
        assert by_text.setdefault(t, got[d]["fingerprint"]) == got[d]["fingerprint"]


def test_warc(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in read("pages")}
    first = {}
    for p in sorted(pages):
        first.setdefault(pages[p], p)
    got = {r["page_id"]: r for r in rows(spark, "op5_warc")}
    assert set(got) == set(pages)
    for p, html in pages.items():
        again = len(html) >= 100 and first[html] != p
        r = got[p]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html), sha(html))
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[html]) if again else ("response", None))


def test_substring_dedup(spark, docs):
    seen, want = set(), {}
    for d in sorted(docs):
        words = docs[d].encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            key = tuple(words[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        want[d] = (len(words), sum(gone), sha(b" ".join(w for w, g in zip(words, gone) if not g)))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(spark, "op7_substring_dedup")}
    assert got == want and sum(x[1] for x in want.values()) > 0


def test_mixing(spark):
    from postwatch.llm.mixing import targets

    given = {r["doc_id"]: r for r in read("documents")}
    got = rows(spark, "op8_mixing")
    sizes, taken = Counter(), Counter()
    for r in got:
        text = given[r["doc_id"]]["text"] or ""
        assert r["size"] == len(text.encode().split())
        assert r["taken"] <= 2 * r["size"]
        sizes[given[r["doc_id"]]["source"]] += r["size"]
        taken[given[r["doc_id"]]["source"]] += r["taken"]
    goal = targets(dict(sizes))
    assert sum(goal.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for r in got:
        source = given[r["doc_id"]]["source"]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(goal[source])
    largest = max(r["size"] for r in got)
    assert all(abs(taken[s] - goal[s]) <= largest for s in goal)
    assert sorted(map(str, got)) == sorted(map(str, rows(spark, "op8_mixing")))


def test_language_id(spark):
    given = {r["doc_id"]: r["lang"] for r in read("documents")}
    got = rows(spark, "op9_language_id")
    own = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in own} == {d for d in given if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == given[r["doc_id"]] for r in own) >= 0.95 * len(own)
    assert all(0 <= r["score"] <= 1 for r in got)


def simhash(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(fps):
    """Smallest id reachable of each id."""
    up = {d: d for d in fps}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: top(d) for d in ids}


def test_simhash(spark, docs):
    fps = {d: simhash(t) for d, t in docs.items()}
    groups = near_groups(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(spark, "op10_simhash")}
    assert got == {d: (f"{fps[d]:016x}", groups[d]) for d in docs}


def test_line_dedup(spark, docs):
    from postwatch.llm.linededup import BLANKS, MIN_CHARS, Earlier

    def runs(own):
        full = [x for x in own if x]
        for i in range(len(full)):
            for j in range(i + 1, len(full) + 1):
                if sum(map(len, full[i:j])) >= MIN_CHARS:
                    yield tuple(full[i:j])
                    break

    lines = {d: [x.strip(BLANKS) for x in t.split("\n")] for d, t in docs.items()}
    holder = {}
    for d in sorted(docs):
        for x in runs(lines[d]):
            holder.setdefault(x, d)
    got = {r["doc_id"]: r for r in rows(spark, "op1_line_dedup")}
    for d, own in lines.items():
        gone = set()
        for a in {holder[x] for x in runs(own)} - {d}:
            there = [x for x in lines[a]]
            gone |= set(Earlier(there, [len(x) for x in there]).blocks(own, [len(x) for x in own]))
        kept = "\n".join(x for i, x in enumerate(docs[d].split("\n")) if i not in gone)
        assert (got[d]["text"], got[d]["n_lines"], got[d]["n_removed"]) == (kept, len(own), len(gone))
    assert sum(r["n_removed"] for r in got.values()) > 0


def test_pipeline(spark, docs):
    import corpus_pipeline as P
    from postwatch.llm.common import keep
    from postwatch.llm.registry import table

    frame = table(spark, SF, "documents")
    columns, seen = frame.columns, []
    for name, stage in P.STAGES:
        frame = keep(stage(spark, frame, SF), name)
        seen.append(frame.count())
        if name != "mixing":
            assert frame.columns == columns
    assert len(docs) >= seen[0] >= seen[2] >= seen[3] > 0 and seen[0] == seen[1]
    assert seen[4] == P.run(spark, SF).count()
