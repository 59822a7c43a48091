"""The queries of the subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postwatch.llm import chat, decontaminate, langid, linededup, lmscore, mixing, ordermin, packing, repair, rlz, simhash, trie, warc
from postwatch.llm.common import keep, keyed_join, text_hash
from postwatch.llm.registry import QUERIES, SQL, query, table
from postwatch.operators.ordinal import with_ordinal

__all__ = ["QUERIES", "SQL"]


def remainder(n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


@query("op9_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = docs.filter(remainder(4) != 2)
    model = langid.fit(labelled, "lang", "text", by=F.col("doc_id"))
    found = langid.identify(docs.select("doc_id", "text"), model, keep_text=False)
    return found.select(
        "doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score",
        F.size("spans").cast("long").alias("n_spans"),
    )


@query("op10_simhash")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.link(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op1_line_dedup")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedupe_lines(docs, counts=True)


DECONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
i AS (
  SELECT item_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
iw AS (
  SELECT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, s + 1, s + least(10, len(w))), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(len(w) - least(10, len(w)) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, s, n, array_to_string(list_slice(w, s + 1, s + n), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS s
        FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, n, item_id FROM dw JOIN iw USING (g, n)),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
              FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id),
posting AS (
  SELECT * FROM (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS p FROM d)
  WHERE term IN (SELECT unnest(w) FROM i)),
frequency AS (SELECT term, count(*) AS c FROM posting GROUP BY term),
part AS (
  SELECT item_id, s, n, s + j AS p, w[s + j + 1] AS term
  FROM (SELECT item_id, w, s, n, unnest(range(n)) AS j
        FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(len(w) - least(10, len(w)) + 1)) AS s
              FROM i WHERE len(w) > 0))),
anchor AS (
  SELECT *, count(*) OVER (PARTITION BY item_id, s) AS size
  FROM (SELECT item_id, s, p, term, row_number() OVER (PARTITION BY item_id, s ORDER BY c, p) AS r,
               count(*) FILTER (WHERE c IS NULL) OVER (PARTITION BY item_id, s) AS unknown
        FROM part LEFT JOIN frequency USING (term))
  WHERE r <= 3 AND unknown = 0),
place AS (SELECT doc_id, item_id, s, r, size, posting.p - anchor.p AS at FROM posting JOIN anchor USING (term)),
near AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near
  FROM (SELECT x.doc_id, x.item_id
        FROM place x JOIN place y
          ON x.doc_id = y.doc_id AND x.item_id = y.item_id AND x.s = y.s AND y.at BETWEEN x.at AND x.at + 5
        GROUP BY x.doc_id, x.item_id, x.s, x.at, x.size HAVING count(DISTINCT y.r) = x.size)
  GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near_items
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)"""


@query("op6_decontamination", DECONTAMINATION)
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), near=True)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"),
    )


@query("op8_mixing")
def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.plan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", mixing.taken().alias("taken"))


CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) + 4 AS n,
         length('<|turn|><|text|></s>') + list_sum(list_transform([role, text], lambda x:
           length(x) + length(x) - length(replace(x, '\', '')) + 2 * list_sum(list_transform(
             ['<|', '<s>', '</s>', '<<SYS>>', '<</SYS>>', '[INST]', '[/INST]'],
             lambda k: (length(x) - length(replace(x, k, ''))) // length(k))))) AS shown
  FROM c),
placed AS (
  SELECT *, row_number() OVER w - 1 AS i, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         first_value(CASE WHEN role = 'system' THEN n ELSE 0 END) OVER w AS system_n,
         first_value(CASE WHEN role = 'system' THEN shown ELSE 0 END) OVER w AS system_shown
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
rest AS (
  SELECT *, 2 * (place // room) + CASE WHEN (place + n - 1) // room > place // room THEN 1 ELSE 0 END AS win
  FROM (SELECT *, CAST(start - system_n AS BIGINT) AS place, greatest(512 - 96 - system_n, 128) AS room FROM placed)
  WHERE i > 0 OR system_n = 0),
opened AS (SELECT conv_id, win, min(place) AS opens FROM rest GROUP BY ALL),
again AS (
  SELECT conv_id, sum(shown) AS shown
  FROM rest JOIN opened USING (conv_id) WHERE opened.win > rest.win AND n <= 96 AND opens - place <= 96 GROUP BY conv_id),
n_opened AS (SELECT conv_id, count(*) AS n FROM opened GROUP BY conv_id),
whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS turns,
         coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(shown) AS shown, any_value(system_shown) AS system_shown
  FROM placed GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(whole.shown + coalesce(again.shown, 0) + (coalesce(n_opened.n, 1) - 1) * system_shown AS BIGINT) AS formatted_chars,
       coalesce(n_opened.n, 1) AS n_windows
FROM whole LEFT JOIN again USING (conv_id) LEFT JOIN n_opened USING (conv_id)"""


@query("op3_chat", CHAT)
def chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast(given.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(given.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    read = chat.read_back(chat.windows(given.unionAll(extra)))
    whole = read.groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("window", "turns", "losses"))).alias("w"), F.sum("chars").alias("chars")
    )
    turns = F.flatten(F.col("w.turns"))
    loss = F.array_join(F.flatten(F.col("w.losses")), "")
    shown = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select(
        F.col("conv").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"),
        F.sha2(shown, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.col("chars").alias("formatted_chars"),
        F.size("w").cast("long").alias("n_windows"),
    )


def neighbours(docs: DataFrame) -> DataFrame:
    """``(id, next_id, need)`` of each distinct id: the next smaller one, after the smallest the largest.

    ``need`` is a third of the longest text with the id, in code points.
    """
    sizes = docs.groupBy("doc_id").agg((F.max(F.length("text")) / 3).cast("int").alias("need"))
    placed = with_ordinal(sizes, "doc_id")
    n = placed.count()
    after = placed.select(F.col("doc_id").alias("next_id"), F.col("ordinal").alias("place"))
    before = placed.select(
        F.col("doc_id").alias("id"), "need", F.pmod(F.col("ordinal") - 1, F.lit(max(n, 1))).alias("place")
    )
    return keep(before.join(after, "place").select("id", "next_id", "need"), "neighbours")


@query("op4_order_minhash")
def order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows that share an id the one with the smallest text hash is the id's document for its neighbour."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    links = neighbours(docs)
    given = (
        keyed_join(docs, links, [("doc_id", "next_id")], ["doc_id", "text"], "inner")
        .select("id", "next_id", F.struct(text_hash("text").alias("th"), F.expr("substring(text, 1, need)").alias("head")).alias("x"))
        .groupBy("id", "next_id")
        .agg(F.min("x")["head"].alias("head"))
    )
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.length("text") - third), F.substring("head", F.lit(1), third)
    )
    texts = docs.join(given, docs["doc_id"].eqNullSafe(given["id"])).select("doc_id", "next_id", "text", edited.alias("edited"))
    signed = keep(
        texts.select(
            "doc_id", "next_id", text_hash("text").alias("th"), F.length("text").cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"), ordermin.signature(F.col("text")).alias("a"),
            ordermin.signature(F.col("edited")).alias("b"),
        ),
        "signed",
    )
    next_one = signed.groupBy(F.col("doc_id").alias("of")).agg(F.min(F.struct("th", "a"))["a"].alias("c"))
    joined = signed.join(next_one, signed["next_id"].eqNullSafe(next_one["of"]))
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", ordermin.fingerprint(F.col("a")).alias("fingerprint"),
        ordermin.fingerprint(F.col("b")).alias("edited_fingerprint"),
        ordermin.likeness(F.col("a"), F.col("b")).alias("near_edited"),
        ordermin.likeness(F.col("a"), F.col("c")).alias("near_next"),
    )


SUBSTRINGS = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (
  SELECT doc_id, s, array_to_string(list_slice(w, s + 1, s + 20), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS s FROM d WHERE len(w) >= 20)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p
  FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS r FROM g) WHERE r > 1),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS text
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS p FROM d) ANTI JOIN gone USING (doc_id, p)
  GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""


@query("op7_substring_dedup", SUBSTRINGS)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rlz.dedupe_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op2_lm_scoring")
def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"), remainder(10) == 0)


ARCHIVES = """
SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN strlen(html) >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(html) >= 100 AND page_id > first THEN first END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)"""


@query("op5_warc", ARCHIVES)
def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select(
        F.col("place").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"), "refers_to",
    )


@query("op11_packing")
def packing_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of conversations with one in four of them damaged; ``gone`` marks those that are dropped."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    code, text = F.crc32(key) % 20, F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id", "turn", F.when(code == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(code == 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (code == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(code == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


@query("op12_repair")
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(damaged(table(spark, sf_dir, "conversations")), gone="gone")


def rebuilt(rows: DataFrame) -> DataFrame:
    """``(conv, part, place, key, size)``: each conversation with the first turns of the one that its hundred begins with.

    A row without a key per conversation stands for those without turns.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = keep(
        rows.filter("conv_id is not null")
        .select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"))
        .withColumn("place", F.row_number().over(order))
        .select("conv", "place", trie.turn_key(F.col("role"), F.col("text")).alias("key"), F.length("text").alias("size")),
        "turns",
    )
    shared = (F.crc32(F.col("conv").cast("string")) % 6).cast("int")
    convs = turns.select("conv").distinct()
    # At most five turns each, for a hundred conversations.
    begin = turns.filter("conv % 100 = 0 and place <= 5").groupBy(F.col("conv").alias("b_conv")).agg(
        F.collect_list(F.struct("place", "key", "size")).alias("turns")
    )
    lent = keyed_join(convs.withColumn("base", F.expr("conv - conv % 100")), keep(begin, "begin"), [("base", "b_conv")], ["conv"], "inner")
    lent = lent.select("conv", F.explode("turns").alias("t")).filter(F.col("t.place") <= shared)
    return (
        convs.select("conv", F.lit(0).alias("part"), F.lit(0).alias("place"), F.lit(None).cast("binary").alias("key"), F.lit(0).alias("size"))
        .unionAll(lent.select("conv", F.lit(0), "t.place", "t.key", "t.size"))
        .unionAll(turns.filter(F.col("place") > shared).select("conv", F.lit(1), "place", "key", "size"))
    )


TRIE = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list(length(role) || ':' || role || text ORDER BY place) AS ids, list(length(text) ORDER BY place) AS sizes
  FROM t GROUP BY conv_id),
h AS (
  -- crc32 of the decimal id, bit by bit
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
           range(strlen(conv_id::VARCHAR)), lambda i: ascii(substr(conv_id::VARCHAR, i + 1, 1))::BIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda k: 0::BIGINT)),
             lambda x, k: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295) % 6 AS h
  FROM own),
seq AS (
  SELECT own.conv_id, list_concat(coalesce(list_slice(base.ids, 1, h), []), list_slice(own.ids, h + 1, len(own.ids))) AS ids,
         list_concat(coalesce(list_slice(base.sizes, 1, h), []), list_slice(own.sizes, h + 1, len(own.sizes))) AS sizes
  FROM own JOIN h USING (conv_id) LEFT JOIN own base ON base.conv_id = own.conv_id - own.conv_id % 100),
node AS (
  SELECT list_slice(ids, 1, depth) AS ids, depth, min(conv_id) AS conv_id, count(*) AS n,
         any_value(coalesce(sizes[depth], 0)) AS size,
         string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = len(ids)) AS ends
  FROM (SELECT *, unnest(range(len(ids) + 1)) AS depth FROM seq) GROUP BY ALL),
parent AS (SELECT list_slice(ids, 1, depth - 1) AS ids, depth - 1 AS depth, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN parent USING (ids, depth)),
below AS (
  SELECT list_slice(ids, 1, up) AS ids, up AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n - 1) * size) AS saved
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM full_node) GROUP BY 1, 2)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM full_node f JOIN below USING (ids, depth)
LEFT JOIN node p ON p.depth = f.depth - 1 AND p.ids = list_slice(f.ids, 1, f.depth - 1)"""


@query("op13_prefix_trie", TRIE)
def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(rebuilt(table(spark, sf_dir, "conversations")), "conv", ["part", "place"])
