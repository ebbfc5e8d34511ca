"""Composition, span parsing, packing and targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernel.functions import text as T
from quernel.functions.ordering import hash_ranked
from quernel.operators import compose as M
from quernel.operators import packing as P
from quernel.operators import sampling as S
from quernel.session import small, table

USABLE = "domain IS NOT NULL AND regexp_matches(text, '\\S')"


def usable(s, d):
    return table(s, d, "documents").where(T.not_blank(F.col("text")) & F.col("domain").isNotNull()).select("doc_id", "domain", "source", "text")


def chosen(s, d, forced=None, n=400):
    return M.choose_domains(s.range(n).withColumnRenamed("id", "mix_id"), usable(s, d), 2, 4, "mix", forced)


def spans(s, d, forced=None):
    n = F.when(F.col("domain") == "nlp", 120).otherwise(40)
    return M.fill_spans(chosen(s, d, forced), usable(s, d).select("doc_id", "domain", "text"), n, "mix")


def documents(s, d, forced=None):
    return M.composed_documents(spans(s, d, forced), table(s, d, "domain_dim"))


def _chosen_sql(forced: str | None) -> str:
    first = f"CASE WHEN domain = '{forced}' THEN 0 ELSE 1 END" if forced else "1"
    return f"""SELECT mix_id, pos, domain FROM (SELECT mix_id, k, domain, row_number() OVER (PARTITION BY mix_id ORDER BY {first}, md5('mix|' || mix_id || '|' || domain), domain) AS pos
        FROM (SELECT i AS mix_id, 2 + CAST(('0x' || substr(md5('mix-k|' || i), 1, 8)) AS BIGINT) % 3 AS k FROM range(400) t(i)), (SELECT DISTINCT domain FROM documents WHERE {USABLE})) WHERE pos <= k"""


def _spans_sql(forced: str | None = None) -> str:
    return f"""SELECT t.mix_id, t.pos, t.domain, d.doc_id, array_to_string(list_slice(regexp_extract_all(d.text, '\\S+'), 1, CASE WHEN t.domain = 'nlp' THEN 120 ELSE 40 END), ' ') AS snippet
        FROM (SELECT *, (row_number() OVER (PARTITION BY domain ORDER BY md5('mix-turn|' || mix_id || '|' || domain), mix_id || '|' || domain) - 1) % n + 1 AS rank
              FROM ({_chosen_sql(forced)}) JOIN (SELECT domain, count(*) AS n FROM documents WHERE {USABLE} GROUP BY domain) USING (domain)) t
        JOIN (SELECT doc_id, domain, text, row_number() OVER (PARTITION BY domain ORDER BY md5('mix|' || doc_id), doc_id) AS rank FROM documents WHERE {USABLE}) d ON t.domain = d.domain AND t.rank = d.rank"""


def _documents_sql(forced: str | None = None) -> str:
    return f"""SELECT mix_id, string_agg(tag || chr(10) || snippet || chr(10), '' ORDER BY pos) AS text FROM ({_spans_sql(forced)}) JOIN domain_dim USING (domain) GROUP BY mix_id"""


def words_by_source(s, d):
    return usable(s, d).select("source", "domain", "doc_id", T.words(F.col("text")).alias("items"))


def packed_single(s, d, size=257):
    out = P.packed(words_by_source(s, d), ["source"], F.col("doc_id"), "items", size, F.floor(F.col("doc_id") / 1024).cast("int"))
    return out.select("source", "chunk_id", F.md5(F.array_join("items", " ")).alias("digest"))


def packed_mixed(s, d, size=257):
    dim = small(table(s, d, "domain_dim").select("domain", "domain_index"))
    turns = S.round_robin(usable(s, d).join(dim, "domain").select("domain", "domain_index", "doc_id", T.words(F.col("text")).alias("items")), "domain", "domain_index", "doc_id", F.floor(F.col("doc_id") / 4096).cast("int"))
    out = P.packed(turns.withColumn("all", F.lit("mixed")), ["all"], F.col("seq"), "items", size, F.floor(F.col("seq") / 1024).cast("int"))
    return out.select("chunk_id", F.md5(F.array_join("items", " ")).alias("digest"))


def routed(s, d, size=129):
    """Windows over the composed documents' spans: control tokens, tokens, domains."""
    dim = small(table(s, d, "domain_dim").select("domain", "domain_index", "vocab_size"))
    items = M.parsed_spans(documents(s, d), "mix_id").join(dim, "domain")
    items = items.select("mix_id", "span_pos", P.routed_items(F.concat(F.lit("<"), F.col("domain"), F.lit(">")), T.words(F.col("body")), F.col("domain"), F.col("domain_index")).alias("items"))
    flat = items.select(F.lit("routed").alias("stream"), (F.col("mix_id") * 64 + F.col("span_pos")).alias("o"), "items")
    return P.packed(flat, ["stream"], F.col("o"), "items", size, F.floor(F.col("o") / 4096).cast("int"))


def routed_targets(s, d):
    told = P.with_targets(routed(s, d), "items", lambda x, y: F.when(y["is_control"], F.concat(F.lit("switch:"), y["domain_index"].cast("string"))).otherwise(y["token"]))
    return told.select("chunk_id", F.md5(F.array_join("targets", " ")).alias("digest"), F.size(F.filter("targets", lambda t: t.startswith("switch:"))).cast("long").alias("n_switches"))


def _routed_tokens_sql() -> str:
    return f"""SELECT token, domain, domain_index, is_control, row_number() OVER (ORDER BY mix_id, pos, k) - 1 AS place FROM (
        SELECT mix_id, pos, domain, domain_index, unnest(list_concat(['<' || domain || '>'], regexp_extract_all(snippet, '\\S+'))) AS token, unnest(range(len(regexp_extract_all(snippet, '\\S+')) + 1)) AS k, unnest(range(len(regexp_extract_all(snippet, '\\S+')) + 1)) = 0 AS is_control
        FROM ({_spans_sql()}) JOIN domain_dim USING (domain))"""


def _packed_sql(source: str, keys: str, size: int) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    select = f"{keys}, " if keys else ""
    return f"""SELECT {select}chunk_id, md5(string_agg(w, ' ' ORDER BY place)) AS digest FROM (SELECT {select}w, place, place // {size} AS chunk_id FROM (SELECT {select}w, row_number() OVER ({part} ORDER BY o, k) - 1 AS place FROM ({source})))
        GROUP BY {select}chunk_id HAVING count(*) = {size}"""


SINGLE = f"SELECT source, doc_id AS o, unnest(regexp_extract_all(text, '\\S+')) AS w, unnest(range(len(regexp_extract_all(text, '\\S+')))) AS k FROM documents WHERE {USABLE}"
MIXED = f"""SELECT unnest(regexp_extract_all(text, '\\S+')) AS w, unnest(range(len(regexp_extract_all(text, '\\S+')))) AS k, turn * 1000 + domain_index AS o FROM (SELECT text, domain_index, row_number() OVER (PARTITION BY domain ORDER BY doc_id) AS turn
    FROM documents JOIN domain_dim USING (domain) WHERE {USABLE})"""

def encoded(s, d, most=60):
    """Composed documents as control tokens and words, spans cut at ``most`` words, documents at ``3 * most + 1`` items."""
    dim = small(table(s, d, "domain_dim").select("domain", "domain_index"))
    items = M.parsed_spans(documents(s, d), "mix_id").join(dim, "domain")
    spans_ = items.select("mix_id", "span_pos", P.routed_items(F.concat(F.lit("<"), F.col("domain"), F.lit(">")), F.slice(T.words(F.col("body")), 1, most), F.col("domain"), F.col("domain_index")).alias("items"))
    whole = spans_.groupBy("mix_id").agg(F.sort_array(F.collect_list(F.struct("span_pos", "items"))).alias("xs")).select("mix_id", F.slice(F.flatten(F.transform("xs", lambda x: x["items"])), 1, 3 * most + 1).alias("items"))
    return whole.select("mix_id", F.size("items").cast("long").alias("n"), F.md5(F.array_join(F.transform("items", lambda x: x["token"]), " ")).alias("digest"))


def natural(s, d, size=257):
    """Windows of one domain recast as routed windows without control tokens: input, next token, domain."""
    dim = small(table(s, d, "domain_dim").select("domain", "domain_index"))
    docs = words_by_source(s, d).join(dim, "domain")
    windows = P.packed(docs, ["domain_index"], F.col("doc_id"), "items", size, F.floor(F.col("doc_id") / 1024).cast("int"))
    told = P.with_targets(windows, "items", lambda x, y: y)
    return told.select("domain_index", "chunk_id", F.md5(F.array_join("targets", " ")).alias("digest"))


def labelled_windows(s, d, size=65):
    """Windows per register label of the stream's rows, each label's text cut its own way."""
    rows = table(s, d, "stage2_stream_dataset").where(T.not_blank(F.col("text")))
    label = F.coalesce("domain_filter", F.lit("web"))
    items = F.when(label == "code", T.words(F.col("text"))).otherwise(T.alpha_words(F.col("text")))
    docs = rows.select(label.alias("label"), "row_id", items.alias("items"))
    out = P.packed(docs, ["label"], F.col("row_id"), "items", size, F.floor(F.col("row_id") / 1024).cast("int"))
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n_windows"), F.max("chunk_id").alias("last"))


def held_out(s, d, size=129):
    """Windows of each source's documents behind the first 20 in hash order."""
    kept = hash_ranked(usable(s, d).select("doc_id", "source", "text"), "held", "doc_id", ["source"]).where("rank > 20")
    docs = kept.select("source", "doc_id", T.words(F.col("text")).alias("items"))
    out = P.packed(docs, ["source"], F.col("doc_id"), "items", size, F.floor(F.col("doc_id") / 1024).cast("int"))
    return out.select("source", "chunk_id", F.md5(F.array_join("items", " ")).alias("digest"))


HELD = f"""SELECT source, doc_id AS o, unnest(w) AS w, unnest(range(len(w))) AS k FROM (SELECT source, doc_id, regexp_extract_all(text, '\\S+') AS w, row_number() OVER (PARTITION BY source ORDER BY md5('held|' || doc_id), doc_id) AS r FROM documents WHERE {USABLE}) WHERE r > 20"""
NATURAL = f"SELECT domain_index, doc_id AS o, unnest(regexp_extract_all(text, '\\S+')) AS w, unnest(range(len(regexp_extract_all(text, '\\S+')))) AS k FROM documents JOIN domain_dim USING (domain) WHERE {USABLE}"

QUERIES = {
    "g6_held_out_composition": (
        lambda s, d: M.fill_spans(chosen(s, d), hash_ranked(usable(s, d).select("doc_id", "domain", "text"), "held", "doc_id", ["domain"]).where("rank > 10").drop("rank"), 40, "mix").select("mix_id", "pos", "domain", "doc_id"),
        f"""WITH held AS (SELECT doc_id, domain FROM documents WHERE {USABLE} QUALIFY row_number() OVER (PARTITION BY domain ORDER BY md5('held|' || doc_id), doc_id) > 10)
        SELECT t.mix_id, t.pos, t.domain, d.doc_id FROM (SELECT *, (row_number() OVER (PARTITION BY domain ORDER BY md5('mix-turn|' || mix_id || '|' || domain), mix_id || '|' || domain) - 1) % n + 1 AS rank FROM ({_chosen_sql(None)}) JOIN (SELECT domain, count(*) AS n FROM held GROUP BY domain) USING (domain)) t
        JOIN (SELECT doc_id, domain, row_number() OVER (PARTITION BY domain ORDER BY md5('mix|' || doc_id), doc_id) AS rank FROM held) d ON t.domain = d.domain AND t.rank = d.rank""",
    ),
    "g8_encode_routed": (
        encoded,
        f"""SELECT mix_id, count(*) AS n, md5(string_agg(token, ' ' ORDER BY pos, k)) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY mix_id ORDER BY pos, k) AS r FROM (SELECT mix_id, pos, unnest(list_concat(['<' || domain || '>'], w)) AS token, unnest(range(len(w) + 1)) AS k
        FROM (SELECT mix_id, pos, domain, list_slice(regexp_extract_all(snippet, '\\S+'), 1, 60) AS w FROM ({_spans_sql()}) WHERE domain IN (SELECT domain FROM domain_dim)))) WHERE r <= 181 GROUP BY mix_id""",
    ),
    "g12_labelled_windows": (
        labelled_windows,
        """SELECT label, CAST(n // 65 AS BIGINT) AS n_windows, CAST(n // 65 - 1 AS BIGINT) AS last FROM (SELECT coalesce(domain_filter, 'web') AS label, sum(CASE WHEN coalesce(domain_filter, 'web') = 'code' THEN len(regexp_extract_all(text, '\\S+')) ELSE len(regexp_extract_all(lower(text), '[a-z'']+')) END) AS n
        FROM stage2_stream_dataset WHERE regexp_matches(text, '\\S') GROUP BY ALL) WHERE n >= 65""",
    ),
    "g13_held_out_windows": (held_out, _packed_sql(HELD, "source", 129)),
    "g14_natural_windows": (
        natural,
        f"""SELECT domain_index, chunk_id, md5(string_agg(w, ' ' ORDER BY place)) AS digest FROM (SELECT *, place // 257 AS chunk_id, place % 257 AS slot, count(*) OVER (PARTITION BY domain_index, place // 257) AS n FROM (SELECT domain_index, w, row_number() OVER (PARTITION BY domain_index ORDER BY o, k) - 1 AS place FROM ({NATURAL})))
        WHERE n = 257 AND slot > 0 GROUP BY domain_index, chunk_id""",
    ),
    "g2_tagged_corpus_split": (
        lambda s, d: S.split(usable(s, d), "doc_id", 0.05, "corpus").groupBy("domain", "part").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(T.word_count(F.col("text"))).alias("n_words")),
        f"""SELECT domain, part, count(*) AS n_docs, CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS n_words FROM (SELECT domain, text, CASE WHEN row_number() OVER (ORDER BY md5('corpus|' || doc_id), doc_id) <= greatest(1, floor(count(*) OVER () * 0.05)) THEN 'val' ELSE 'train' END AS part
        FROM documents WHERE {USABLE}) GROUP BY ALL""",
    ),
    "g3_compose_documents": (lambda s, d: documents(s, d).select("mix_id", "text"), _documents_sql()),
    "g3_switch_metadata": (
        lambda s, d: documents(s, d).select("mix_id", F.posexplode("switches").alias("p", "x")).select("mix_id", F.col("p").cast("long").alias("p"), "x.domain", "x.char_offset", F.col("x.tag_len").cast("long").alias("tag_len")),
        f"""SELECT mix_id, row_number() OVER w - 1 AS p, domain, CAST(coalesce(sum(length(tag) + length(snippet) + 2) OVER (PARTITION BY mix_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_offset, length(tag) AS tag_len
        FROM ({_spans_sql()}) JOIN domain_dim USING (domain) WINDOW w AS (PARTITION BY mix_id ORDER BY pos)""",
    ),
    "g4_forced_domain": (lambda s, d: documents(s, d, "nlp").select("mix_id", "text"), _documents_sql("nlp")),
    "g5_webtext_labels": (
        lambda s, d: M.choose_domains(s.range(400).withColumnRenamed("id", "mix_id"), table(s, d, "stage2_stream_dataset").select(F.col("domain_filter").alias("domain")).where("domain is not null"), 2, 4, "mix"),
        """SELECT mix_id, pos, domain FROM (SELECT mix_id, k, domain, row_number() OVER (PARTITION BY mix_id ORDER BY md5('mix|' || mix_id || '|' || domain), domain) AS pos FROM (SELECT i AS mix_id, 2 + CAST(('0x' || substr(md5('mix-k|' || i), 1, 8)) AS BIGINT) % 3 AS k FROM range(400) t(i)),
        (SELECT DISTINCT domain_filter AS domain FROM stage2_stream_dataset WHERE domain_filter IS NOT NULL)) WHERE pos <= k""",
    ),
    "g7_span_parse": (
        lambda s, d: M.parsed_spans(documents(s, d), "mix_id").select("mix_id", "span_pos", "domain", F.rtrim(F.regexp_replace("body", r"\n$", "")).alias("body")),
        f"SELECT mix_id, pos - 1 AS span_pos, domain, rtrim(snippet) AS body FROM ({_spans_sql()}) WHERE domain IN (SELECT domain FROM domain_dim)",
    ),
    "g9_pack_single": (packed_single, _packed_sql(SINGLE, "source", 257)),
    "g10_pack_mixed": (packed_mixed, _packed_sql(MIXED, "", 257)),
    "g11_pack_routed": (
        lambda s, d: routed(s, d).select("chunk_id", F.md5(F.array_join(F.transform("items", lambda x: F.concat(x["token"], F.lit("/"), x["domain"])), " ")).alias("digest"), F.size(F.filter("items", lambda x: x["is_control"])).cast("long").alias("n_control")),
        f"""SELECT place // 129 AS chunk_id, md5(string_agg(token || '/' || domain, ' ' ORDER BY place)) AS digest, CAST(count_if(is_control) AS BIGINT) AS n_control FROM ({_routed_tokens_sql()}) GROUP BY ALL HAVING count(*) = 129""",
    ),
    "g15_routed_targets": (
        routed_targets,
        f"""SELECT chunk_id, md5(string_agg(CASE WHEN is_control THEN 'switch:' || domain_index ELSE token END, ' ' ORDER BY place)) AS digest, CAST(count_if(is_control) AS BIGINT) AS n_switches FROM (SELECT *, place // 129 AS chunk_id, place % 129 AS slot, count(*) OVER (PARTITION BY place // 129) AS n FROM ({_routed_tokens_sql()}))
        WHERE n = 129 AND slot > 0 GROUP BY chunk_id""",
    ),
    "g16_switch_density": (
        lambda s, d: routed_targets(s, d).agg(F.count(F.lit(1)).alias("n_windows"), F.sum("n_switches").alias("n_switches"), F.round(F.sum("n_switches") / (F.count(F.lit(1)) * 128), 8).alias("per_position")),
        f"""SELECT CAST(count(*) // 128 AS BIGINT) AS n_windows, CAST(count_if(is_control) AS BIGINT) AS n_switches, round(count_if(is_control)::DOUBLE / count(*), 8) AS per_position FROM (SELECT *, place % 129 AS slot, count(*) OVER (PARTITION BY place // 129) AS n FROM ({_routed_tokens_sql()})) WHERE n = 129 AND slot > 0""",
    ),
    "a3_domain_appearances": (
        lambda s, d: chosen(s, d).groupBy("domain").agg(F.count(F.lit(1)).alias("n")),
        f"SELECT domain, count(*) AS n FROM ({_chosen_sql(None)}) GROUP BY domain",
    ),
    "a4_switches_per_document": (
        lambda s, d: chosen(s, d).groupBy("mix_id").agg(F.count(F.lit(1)).alias("n_spans")).groupBy("n_spans").agg(F.count(F.lit(1)).alias("n_docs")),
        f"SELECT n_spans, count(*) AS n_docs FROM (SELECT mix_id, count(*) AS n_spans FROM ({_chosen_sql(None)}) GROUP BY mix_id) GROUP BY n_spans",
    ),
}
