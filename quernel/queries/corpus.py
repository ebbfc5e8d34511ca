"""Sources, projections, filters and rule classifiers over the corpus tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernel.functions import classify as C
from quernel.functions import ordering as H
from quernel.functions import text as T
from quernel.operators import quality
from quernel.plans.scan import prefix_sum
from quernel.session import small, table
from quernel.sources.readers import retry_delays

#: Licences whose code may be taken.
CODE_LICENSES = ["mit", "apache-2.0", "bsd-3-clause", "bsd-2-clause", "isc"]


def _in(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _phrases(column: str, phrases: list[str]) -> str:
    return " + ".join(f"CAST(contains(lower({column}), '{p}') AS INT)" for p in phrases)


def _pattern(p: str) -> str:
    return p.replace("'", "''")


def _hits(seen: str, label: C.Label) -> str:
    return " + ".join(f"len(regexp_extract_all({seen}, '{_pattern(p)}'))" for p in label.patterns)


def _classified(seen: str, labels, default: str, threshold: int) -> str:
    names = [x.name for x in labels]
    hits = ", ".join(f"{_hits(seen, x)} AS h_{x.name}" for x in labels)
    cases = " ".join(f"WHEN h_{n} = most AND most >= {threshold} THEN '{n}'" for n in names)
    return f"""SELECT doc_id, CASE {cases} ELSE {default} END AS label FROM (
        SELECT *, greatest({", ".join("h_" + n for n in names)}) AS most FROM (SELECT doc_id, text, {hits} FROM documents))"""


SEEN = "coalesce(substring(text, 1, 2000), '')"
BUCKETS = "CASE CAST(('0x' || substr(md5('register|' || coalesce(substring(text, 1, 200), '')), 1, 8)) AS BIGINT) % 4 WHEN 0 THEN 'nlp_news' WHEN 1 THEN 'nlp_opinion' WHEN 2 THEN 'nlp_narrative' ELSE 'nlp_reference' END"


WHOLE = "coalesce(text, '')"
WHOLE_BUCKETS = BUCKETS.replace("coalesce(substring(text, 1, 200), '')", WHOLE)


def classified(spark, d, sample=2000):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", C.classified(F.col("text"), C.DOMAINS, F.lit("nlp"), sample, 4).alias("label"))


def register(spark, d, sample=2000):
    """Without a hit the bucket is drawn by the hash of the start, or of the whole text where that is classified."""
    docs = table(spark, d, "documents")
    names = F.array(*[F.lit(x.name) for x in C.REGISTERS])
    drawn_by = F.substring("text", 1, 200) if sample else F.col("text")
    fallback = F.element_at(names, (H.hash_int("register", F.coalesce(drawn_by, F.lit(""))) % 4 + 1).cast("int"))
    return docs.select("doc_id", C.classified(F.col("text"), C.REGISTERS, fallback, sample, 1).alias("label"))


def two_levels(spark, d, sample=2000):
    top = classified(spark, d, sample).withColumnRenamed("label", "top")
    return top.join(register(spark, d, sample), "doc_id").select("doc_id", F.when(F.col("top") == "nlp", F.col("label")).otherwise(F.col("top")).alias("label"))


def label_distribution(spark, d, sample=2000):
    return classified(spark, d, sample).join(table(spark, d, "documents").select("doc_id", "domain"), "doc_id").groupBy("domain", "label").agg(F.count(F.lit(1)).alias("n"))


def line_offsets(spark, d):
    """Byte offset of each document in its source's file, one line each in doc_id order."""
    docs = table(spark, d, "documents").where(T.not_blank(F.col("text"))).select("source", "doc_id", (T.byte_count(F.col("text")) + 1).alias("size"))
    return prefix_sum(docs, ["source"], [F.col("doc_id")], "size", "offset", F.floor(F.col("doc_id") / 4096).cast("int")).select("source", "doc_id", F.col("offset").cast("long").alias("offset"))


def passes(spark, d, n=3):
    docs = table(spark, d, "documents").where(T.not_blank(F.col("text"))).select("domain", "doc_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pass_num"))
    keyed = docs.withColumn("k", F.concat_ws("|", F.col("pass_num").cast("string"), F.col("doc_id").cast("string")))
    return H.hash_ranked(keyed, "pass", "k", ["domain", "pass_num"]).select("domain", "pass_num", "doc_id", "rank")


def passes_in_order(spark, d, n=3):
    docs = table(spark, d, "documents").where(T.not_blank(F.col("text"))).select("domain", "doc_id", F.lit(1).alias("one"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pass_num"))
    ranked = prefix_sum(docs, ["domain", "pass_num"], [F.col("doc_id")], "one", "before", F.floor(F.col("doc_id") / 4096).cast("int"))
    return ranked.select("domain", "pass_num", "doc_id", (F.col("before") + 1).alias("rank"))


def tagged_corpus(spark, d):
    """Each shard's corpus written as tagged, separator-joined text and parsed again."""
    docs = table(spark, d, "documents").where(T.not_blank(F.col("text")) & F.col("domain").isNotNull())
    dim = small(table(spark, d, "domain_dim").select("domain", "tag"))
    body = docs.join(dim, "domain").select("shard_id", "doc_id", T.tagged(F.col("tag"), F.col("text")).alias("t"))
    pattern = r"(?s)^<domain:([^>]+)>\n(.*)$"
    return body.select("shard_id", F.regexp_extract("t", pattern, 1).alias("domain"), T.byte_count(F.regexp_extract("t", pattern, 2)).alias("n")).groupBy("shard_id", "domain").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_bytes")
    )


def scraped(spark, d):
    h = table(spark, d, "history")
    line = F.concat(F.lit("step "), F.col("step").cast("string"), F.lit("/6000 loss="), F.when(F.col("loss").isNotNull(), F.format_string("%.3f", "loss")).otherwise("nan"))
    pattern = r"step ([0-9]+)/([0-9]+) loss=([0-9.]+|nan)"
    lines = h.where(F.col("loss").isNull() | ~F.isnan("loss")).select("arm", line.alias("line")).where(F.col("line").rlike(pattern))
    parsed = lines.select("arm", F.regexp_extract("line", pattern, 1).cast("long").alias("step"), F.regexp_extract("line", pattern, 2).cast("long").alias("total"), (F.regexp_extract("line", pattern, 3) == "nan").alias("lost"))
    return parsed.groupBy("arm").agg(F.max("step").alias("step"), F.max("total").alias("total"), F.count_if("lost").alias("n_lost"))


QUERIES = {
    "s1_range_slice": (
        lambda s, d: table(s, d, "documents").orderBy("doc_id").limit(100).select("doc_id", "source"),
        "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100",
    ),
    "s2_take_then_filter": (
        lambda s, d: table(s, d, "documents").orderBy("doc_id").limit(200).where(T.not_blank(F.col("text"))).select("doc_id"),
        "SELECT doc_id FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 200) WHERE regexp_matches(text, '\\S')",
    ),
    "s3_passes_reshuffled": (
        passes,
        """SELECT domain, pass_num, doc_id, row_number() OVER (PARTITION BY domain, pass_num ORDER BY md5('pass|' || pass_num || '|' || doc_id), pass_num || '|' || doc_id) AS rank
        FROM documents, (SELECT unnest([0, 1, 2]) AS pass_num) WHERE regexp_matches(text, '\\S')""",
    ),
    "s4_passes_in_order": (
        passes_in_order,
        "SELECT domain, pass_num, doc_id, row_number() OVER (PARTITION BY domain, pass_num ORDER BY doc_id) AS rank FROM documents, (SELECT unnest([0, 1, 2]) AS pass_num) WHERE regexp_matches(text, '\\S')",
    ),
    "s5_classified_stream": (
        lambda s, d: classified(s, d).where("label <> 'nlp'"),
        f"SELECT * FROM ({_classified(SEEN, C.DOMAINS, chr(39) + 'nlp' + chr(39), 4)}) WHERE label <> 'nlp'",
    ),
    "s6_blend_members": (
        lambda s, d: table(s, d, "documents").where(T.not_blank(F.col("text"))).join(small(table(s, d, "blend").select("domain", "source", "weight")), ["domain", "source"])
        .groupBy("domain", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.max("weight").alias("weight")),
        "SELECT domain, source, count(*) AS n_docs, max(weight) AS weight FROM documents JOIN blend USING (domain, source) WHERE regexp_matches(text, '\\S') GROUP BY domain, source",
    ),
    "s7_empty_pass_guard": (
        lambda s, d: table(s, d, "documents").groupBy("source").agg(F.count_if(T.not_blank(F.col("text"))).alias("usable")).select("source", "usable", (F.col("usable") == 0).alias("is_error")),
        "SELECT source, CAST(count_if(coalesce(regexp_matches(text, '\\S'), false)) AS BIGINT) AS usable, count_if(coalesce(regexp_matches(text, '\\S'), false)) = 0 AS is_error FROM documents GROUP BY source",
    ),
    "s9_line_offsets": (
        line_offsets,
        """SELECT source, doc_id, CAST(coalesce(sum(octet_length(encode(text)) + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
        FROM documents WHERE regexp_matches(text, '\\S')""",
    ),
    "s11_retry_schedule": (
        lambda s, d: s.createDataFrame(list(enumerate(retry_delays())), "try_num int, seconds int"),
        "SELECT CAST(k AS INT) AS try_num, CAST(least(90, 5 * 2 ** k) AS INT) AS seconds FROM range(6) t(k)",
    ),
    "s12_shard_assignment": (
        lambda s, d: H.hash_ranked(table(s, d, "documents").select("doc_id"), "shard", "doc_id").select("doc_id", F.pmod(F.col("rank") - 1, F.lit(8)).alias("worker")),
        "SELECT doc_id, (row_number() OVER (ORDER BY md5('shard|' || doc_id), doc_id) - 1) % 8 AS worker FROM documents",
    ),
    "s13_tagged_corpus": (
        tagged_corpus,
        """SELECT shard_id, domain, count(*) AS n_docs, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes FROM documents JOIN domain_dim USING (domain)
        WHERE regexp_matches(text, '\\S') GROUP BY shard_id, domain""",
    ),
    "s14_routed_corpus_nonblank": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n\n")).alias("part")).where(F.trim("part") != "").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_parts")),
        "SELECT doc_id, count(*) AS n_parts FROM (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS part FROM documents) WHERE trim(part) <> '' GROUP BY doc_id",
    ),
    "s16_source_override": (
        lambda s, d: table(s, d, "blend").where("domain <> 'nlp'").select("domain", "source", "weight").unionByName(s.createDataFrame([("nlp", "book_shelf", 1.0)], "domain string, source string, weight double")),
        "SELECT domain, source, weight FROM blend WHERE domain <> 'nlp' UNION ALL SELECT 'nlp', 'book_shelf', CAST(1.0 AS DOUBLE)",
    ),
    "s17_held_out_skip": (
        lambda s, d: H.hash_ranked(table(s, d, "documents").select("doc_id", "source"), "held", "doc_id", ["source"]).where("rank > 20").select("doc_id", "source"),
        "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('held|' || doc_id), doc_id) > 20",
    ),
    "s19_latest_checkpoint": (
        lambda s, d: table(s, d, "history").select("arm", F.concat(F.col("arm"), F.lit("_step_"), F.col("step").cast("string"), F.lit(".ckpt")).alias("path"))
        .select("arm", "path", F.regexp_extract("path", "_step_([0-9]+)", 1).cast("long").alias("step")).groupBy("arm").agg(F.max_by("path", "step").alias("path")),
        "SELECT arm, arm || '_step_' || max(step) || '.ckpt' AS path FROM history GROUP BY arm",
    ),
    "s20_strided_history": (
        lambda s, d: table(s, d, "history").select("run_id", "step").distinct().join(table(s, d, "history").groupBy("run_id").agg(F.min("step").alias("a"), F.max("step").alias("b")), "run_id")
        .where("step % 500 = 0 or step = a or step = b").select("run_id", "step"),
        """SELECT DISTINCT h.run_id, step FROM history h JOIN (SELECT run_id, min(step) AS a, max(step) AS b FROM history GROUP BY run_id) e ON h.run_id = e.run_id
        WHERE step % 500 = 0 OR step = a OR step = b""",
    ),
    "s21_log_scrape": (
        scraped,
        "SELECT arm, max(step) AS step, CAST(6000 AS BIGINT) AS total, CAST(count_if(loss IS NULL) AS BIGINT) AS n_lost FROM history WHERE loss IS NULL OR NOT isnan(loss) GROUP BY arm",
    ),
    "k3_byte_budget": (
        lambda s, d: H.budget_trim(table(s, d, "documents").where(T.not_blank(F.col("text"))).select("domain", "doc_id", T.byte_count(F.col("text")).alias("n_bytes")), "n_bytes", F.lit(200_000), "cache", "doc_id", ["domain"])
        .select("domain", "doc_id", "n_bytes"),
        """SELECT domain, doc_id, n_bytes FROM (SELECT domain, doc_id, octet_length(encode(text)) AS n_bytes, coalesce(sum(octet_length(encode(text))) OVER
        (PARTITION BY domain ORDER BY md5('cache|' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents WHERE regexp_matches(text, '\\S')) WHERE before < 200000""",
    ),
    "k6_retention": (
        lambda s, d: table(s, d, "history").select("run_id", "step").distinct().join(table(s, d, "history").groupBy("run_id").agg(F.max("step").alias("newest")), "run_id").where("step < newest").select("run_id", "step"),
        "SELECT DISTINCT run_id, step FROM history QUALIFY step < max(step) OVER (PARTITION BY run_id)",
    ),
    "proj_extract_code": (
        lambda s, d: table(s, d, "code_file").select("file_id", T.allowed_code(F.col("code"), F.col("language"), F.col("license"), ["python"], CODE_LICENSES).alias("text")).where("text is not null"),
        f"SELECT file_id, code AS text FROM code_file WHERE lower(trim(language)) = 'python' AND lower(trim(license)) IN ({_in(CODE_LICENSES)}) AND code IS NOT NULL",
    ),
    "proj_title_and_body": (
        lambda s, d: table(s, d, "repository").select("repo_id", F.when(F.col("license_text") != "", F.concat_ws("\n", "repo_name", "license_text")).alias("text")),
        "SELECT repo_id, CASE WHEN license_text <> '' THEN concat_ws(chr(10), repo_name, license_text) END AS text FROM repository",
    ),
    "proj_tagged_documents": (
        lambda s, d: table(s, d, "documents").join(small(table(s, d, "domain_dim")), "domain").select("doc_id", T.tagged(F.col("tag"), F.col("text"), "\n<|endofdoc|>\n").alias("tagged")),
        "SELECT doc_id, tag || chr(10) || text || chr(10) || '<|endofdoc|>' || chr(10) AS tagged FROM documents JOIN domain_dim USING (domain)",
    ),
    "proj_sizes": (
        lambda s, d: table(s, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("n_words"), T.byte_count(F.col("text")).alias("n_bytes"), F.length("text").cast("long").alias("n_chars")),
        "SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS n_words, octet_length(encode(text)) AS n_bytes, length(text) AS n_chars FROM documents",
    ),
    "proj_snippet": (
        lambda s, d: table(s, d, "documents").select("doc_id", T.snippet(F.col("text"), 40).alias("snippet")),
        "SELECT doc_id, array_to_string(list_slice(regexp_extract_all(text, '\\S+'), 1, 40), ' ') AS snippet FROM documents",
    ),
    "proj_words_and_signs": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.size(T.words_and_signs(F.col("text"))).cast("long").alias("n"), F.md5(F.array_join(T.words_and_signs(F.col("text")), " ")).alias("digest")).where("text is not null"),
        r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS n, md5(array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'), ' ')) AS digest FROM documents WHERE text IS NOT NULL",
    ),
    "proj_alpha_words": (
        lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", F.size(T.alpha_words(F.col("text"))).cast("long").alias("n")),
        "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z'']+')) AS n FROM documents WHERE text IS NOT NULL",
    ),
    "proj_context_and_target": (
        lambda s, d: table(s, d, "eval_item").select("item_id", T.context_and_target(F.col("text"))[0].alias("context"), T.strip_signs(T.context_and_target(F.col("text"))[1]).alias("target")).where("context is not null"),
        """SELECT item_id, regexp_extract(text, '(?s)^(.*) ([^ ]*)$', 1) AS context, regexp_replace(regexp_replace(regexp_extract(text, '(?s)^(.*) ([^ ]*)$', 2), '^[.,;:!?"'']+', ''), '[.,;:!?"'']+$', '') AS target
        FROM eval_item WHERE contains(text, ' ')""",
    ),
    "proj_corruption": (
        lambda s, d: table(s, d, "eval_item").select("item_id", "text", F.posexplode(F.split("text", "")).alias("pos", "c"))
        .withColumn("u", H.uniform("noise", F.col("item_id"), F.col("pos"))).withColumn("kind", H.uniform("kind", F.col("item_id"), F.col("pos")))
        .withColumn("hit", (F.col("u") < 0.08) & ~F.col("c").rlike(r"^\s$"))
        .groupBy("item_id").agg(F.count(F.lit(1)).alias("n_chars"), F.count_if("hit").alias("n_hit"), F.count_if(F.col("hit") & (F.col("kind") < 0.35)).alias("n_substituted"), F.count_if(F.col("hit") & F.col("kind").between(0.35, 0.55)).alias("n_deleted")),
        """SELECT item_id, count(*) AS n_chars, CAST(count_if(hit) AS BIGINT) AS n_hit, CAST(count_if(hit AND kind < 0.35) AS BIGINT) AS n_substituted, CAST(count_if(hit AND kind BETWEEN 0.35 AND 0.55) AS BIGINT) AS n_deleted FROM (
        SELECT *, u < 0.08 AND NOT regexp_matches(c, '^\\s$') AS hit FROM (SELECT item_id, c, CAST(('0x' || substr(md5('noise|' || item_id || '|' || pos), 1, 8)) AS BIGINT) / 4294967296.0 AS u,
        CAST(('0x' || substr(md5('kind|' || item_id || '|' || pos), 1, 8)) AS BIGINT) / 4294967296.0 AS kind FROM (
        SELECT item_id, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS pos FROM eval_item))) GROUP BY item_id""",
    ),
    "proj_letter_classes": (
        lambda s, d: table(s, d, "token_vocab").select("token_id", F.col("piece").rlike(r"^\p{L}+$").alias("is_alpha"), (F.col("piece").rlike(r"^[\p{L}\p{N}]+$") & ~F.col("piece").rlike(r"^\p{N}+$")).alias("is_word")),
        r"SELECT token_id, regexp_matches(piece, '^\p{L}+$') AS is_alpha, regexp_matches(piece, '^[\p{L}\p{N}]+$') AND NOT regexp_matches(piece, '^\p{N}+$') AS is_word FROM token_vocab",
    ),
    "proj_pretty_numbers": (
        lambda s, d: table(s, d, "token_shard").select("shard_id", F.coalesce(F.format_number("target_tokens", 0), F.lit("-")).alias("pretty")),
        "SELECT shard_id, coalesce(format('{:,}', target_tokens), '-') AS pretty FROM token_shard",
    ),
    "proj_rounding": (
        lambda s, d: table(s, d, "shard_source").select("shard_id", "source", "lang", F.bround(F.col("target_weight") * 8, 0).alias("eighths")),
        "SELECT shard_id, source, lang, round_even(target_weight * 8, 0) AS eighths FROM shard_source",
    ),
    "proj_html_escape": (
        lambda s, d: table(s, d, "stage2_stream_dataset").select("row_id", T.html_escaped(F.col("text")).alias("escaped")),
        "SELECT row_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM stage2_stream_dataset",
    ),
    "proj_canonical_pieces": (
        lambda s, d: table(s, d, "token_vocab").groupBy(T.canonical_piece(F.col("piece")).alias("canonical")).agg(F.count(F.lit(1)).alias("n"), F.min("token_id").alias("first_id")),
        "SELECT lower(regexp_replace(regexp_replace(piece, '^[▁_ ]+', ''), '[▁_ ]+$', '')) AS canonical, count(*) AS n, min(token_id) AS first_id FROM token_vocab GROUP BY ALL",
    ),
    "proj_log_norms": (
        lambda s, d: table(s, d, "history").where("loss is not null and not isnan(loss)").select("run_id", "arm", "step", F.round(F.col("loss") / F.log(F.lit(2.0)), 6).alias("bits"), F.round(F.exp("loss"), 3).alias("ppl")).distinct(),
        "SELECT DISTINCT run_id, arm, step, round(loss / ln(2.0::DOUBLE), 6) AS bits, round(exp(loss), 3) AS ppl FROM history WHERE NOT isnan(loss)",
    ),
    "proj_result_key": (
        lambda s, d: table(s, d, "history").select(F.concat("arm", F.when(F.col("step") >= 3000, "-large").otherwise(""), F.lit("@"), F.col("step").cast("string")).alias("key")).distinct(),
        "SELECT DISTINCT arm || CASE WHEN step >= 3000 THEN '-large' ELSE '' END || '@' || step AS key FROM history",
    ),
    "proj_progress": (
        lambda s, d: table(s, d, "history").groupBy("run_id").agg(F.max("step").alias("step")).select("run_id", F.round(F.col("step") * 100.0 / 6000, 1).alias("percent"), F.when(F.col("step") >= 5000, "done").when(F.col("step") > 0, "running").otherwise("pending").alias("state")),
        "SELECT run_id, round(max(step) * 100.0::DOUBLE / 6000, 1) AS percent, CASE WHEN max(step) >= 5000 THEN 'done' WHEN max(step) > 0 THEN 'running' ELSE 'pending' END AS state FROM history GROUP BY run_id",
    ),
    "f1_nonempty": (
        lambda s, d: table(s, d, "documents").where("text is not null and text <> ''").groupBy("source").agg(F.count(F.lit(1)).alias("n")),
        "SELECT source, count(*) AS n FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY source",
    ),
    "f2_url_parts": (
        lambda s, d: table(s, d, "documents").where(quality.url_matches(F.col("url"), ["/vendor/", "/payload/", "senund"])).select("doc_id", "url"),
        "SELECT doc_id, url FROM documents WHERE contains(url, '/vendor/') OR contains(url, '/payload/') OR contains(url, 'senund')",
    ),
    "f3_license_allow_list": (
        lambda s, d: table(s, d, "code_file").where(F.lower(F.trim("license")).isin(CODE_LICENSES)).groupBy(F.lower(F.trim("language")).alias("language")).agg(F.count(F.lit(1)).alias("n")),
        f"SELECT lower(trim(language)) AS language, count(*) AS n FROM code_file WHERE lower(trim(license)) IN ({_in(CODE_LICENSES)}) GROUP BY ALL",
    ),
    "f4_article_quality": (
        lambda s, d: table(s, d, "documents").where(quality.is_article(F.col("text"), 100, 2000)).select("doc_id"),
        f"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '\\S+')) BETWEEN 100 AND 2000 AND {_phrases('text', quality.BOILERPLATE)} < 2",
    ),
    "f5_copy_words": (
        lambda s, d: quality.copy_words(table(s, d, "documents")),
        f"""SELECT doc_id, word FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM documents) WHERE len(w) >= 17)
        WHERE length(word) >= 5 AND word NOT IN ({_in(quality.STOPWORDS)}) GROUP BY doc_id, word HAVING max(pos) - min(pos) >= 15""",
    ),
    "f6_copy_structured": (
        lambda s, d: quality.copy_structured(table(s, d, "documents"), least_letters=7, least_gap=40).select("doc_id"),
        f"""SELECT DISTINCT doc_id FROM (SELECT doc_id, word FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM documents) WHERE len(w) >= 42)
        WHERE length(word) >= 7 AND word NOT IN ({_in(quality.STOPWORDS)}) GROUP BY doc_id, word HAVING max(pos) - min(pos) >= 40)""",
    ),
    "f8_unknown_domain": (
        lambda s, d: table(s, d, "stage2_stream_dataset").select("row_id", F.lower(F.trim("domain")).alias("domain")).join(small(table(s, d, "domain_dim")), "domain").select("row_id", "domain", "domain_index"),
        "SELECT row_id, lower(trim(s.domain)) AS domain, domain_index FROM stage2_stream_dataset s JOIN domain_dim d ON lower(trim(s.domain)) = d.domain",
    ),
    "f9_least_length": (
        lambda s, d: table(s, d, "documents").where(F.size(T.words(F.col("text"))) >= 2).select("doc_id"),
        "SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '\\S+')) >= 2",
    ),
    "f10_context_fits": (
        lambda s, d: table(s, d, "eval_item").where((T.word_count(F.col("text")) <= 80) & T.not_blank(F.col("text"))).select("item_id"),
        "SELECT item_id FROM eval_item WHERE len(regexp_extract_all(text, '\\S+')) <= 80 AND regexp_matches(text, '\\S')",
    ),
    "c1_domain_classifier": (classified, _classified(SEEN, C.DOMAINS, "'nlp'", 4)),
    "c2_register_classifier": (register, _classified(SEEN, C.REGISTERS, BUCKETS, 1)),
    "c3_two_levels": (
        two_levels,
        f"SELECT a.doc_id, CASE WHEN a.label = 'nlp' THEN b.label ELSE a.label END AS label FROM ({_classified(SEEN, C.DOMAINS, chr(39) + 'nlp' + chr(39), 4)}) a JOIN ({_classified(SEEN, C.REGISTERS, BUCKETS, 1)}) b USING (doc_id)",
    ),
    "c4_label_distribution": (
        label_distribution,
        f"SELECT domain, label, count(*) AS n FROM documents JOIN ({_classified(SEEN, C.DOMAINS, chr(39) + 'nlp' + chr(39), 4)}) USING (doc_id) GROUP BY ALL",
    ),
    # The same on whole texts; those above see a text's leading sample (P8), as the reference does.
    "s5_whole_texts": (
        lambda s, d: classified(s, d, None).where("label <> 'nlp'"),
        f"SELECT * FROM ({_classified(WHOLE, C.DOMAINS, chr(39) + 'nlp' + chr(39), 4)}) WHERE label <> 'nlp'",
    ),
    "c1_whole_texts": (lambda s, d: classified(s, d, None), _classified(WHOLE, C.DOMAINS, "'nlp'", 4)),
    "c2_whole_texts": (lambda s, d: register(s, d, None), _classified(WHOLE, C.REGISTERS, WHOLE_BUCKETS, 1)),
    "c3_whole_texts": (
        lambda s, d: two_levels(s, d, None),
        f"SELECT a.doc_id, CASE WHEN a.label = 'nlp' THEN b.label ELSE a.label END AS label FROM ({_classified(WHOLE, C.DOMAINS, chr(39) + 'nlp' + chr(39), 4)}) a JOIN ({_classified(WHOLE, C.REGISTERS, WHOLE_BUCKETS, 1)}) b USING (doc_id)",
    ),
    "c4_whole_texts": (
        lambda s, d: label_distribution(s, d, None),
        f"SELECT domain, label, count(*) AS n FROM documents JOIN ({_classified(WHOLE, C.DOMAINS, chr(39) + 'nlp' + chr(39), 4)}) USING (doc_id) GROUP BY ALL",
    ),
}
