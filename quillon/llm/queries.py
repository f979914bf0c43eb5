"""The numbered queries: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import attribution, conversations, dedup, language, mixing, packing, pii, quality, resampling, sharding, simhash, tokenids, warc
from quillon.llm.common import documents


def op1_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir, "doc_id", "text", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir, "doc_id", "text"))


def op3_tree_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(documents(spark, sf_dir, "doc_id", "text")).drop("row")


def op4_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir, "doc_id", "text"))


def op5_patched_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.token_files(documents(spark, sf_dir, "doc_id", "text"))


def op6_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(documents(spark, sf_dir, "doc_id", "text", "source"))


def op8_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_tokens(documents(spark, sf_dir, "doc_id", "text"))


def op9_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir, "doc_id", "text"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_risk_controlled_rules,
        op2_prefix_shards,
        op3_tree_merge_dedup,
        op4_boosted_pii,
        op5_patched_token_blocks,
        op6_naive_bayes_language,
        op7_mixture,
        op8_section_tokens,
        op9_golay_simhash,
        op10_best_fit_packing,
        op11_importance_resampling,
        op12_conversation_repair,
        op13_warc_packages,
    )
}


def _crc_table() -> list[int]:
    """The byte table of CRC-32, from its polynomial."""
    out = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        out.append(b)
    return out


_GRID = ", ".join(f"('{r}', {i}, {v}::DOUBLE)" for r, g in quality.GRIDS.items() for i, v in enumerate(g))
_RULES = list(quality.GRIDS)
_P = quality.ALPHA / len(_RULES)

def _edits(state: int) -> str:
    """SQL: the cheapest edits from a state with a row to come, before any insertion; suffixes (cost, audit, rows) of later places are e, s, u, a."""
    name, after, role = "esua"[state], "esua"[conversations.AFTER[state]], conversations.NAMES[conversations.AFTER[state]]
    here = {"e": "CASE WHEN ini = 's' THEN s WHEN ini = 'u' THEN u END", "s": "CASE WHEN ini = 'u' THEN u END", "u": "CASE WHEN ini = 'a' THEN a END", "a": "CASE WHEN ini = 'u' THEN u END"}[name]
    put = lambda way, letter, cost, item: f"CASE WHEN ({way}) IS NOT NULL THEN {{'c': ({way}).c + {cost}, 'a': '{letter}' || ({way}).a, 'm': {item} || ({way}).m}} END"
    stays = [f"CASE WHEN fault <> 'must' THEN {put(here, 'K', 'stays', '[role || chr(58) || text]')} END", f"CASE WHEN fault <> 'must' THEN {put(after, 'R', '1 + stays', f'[{chr(39)}{role}:{chr(39)} || text]')} END"]
    return f"list_sort([x FOR x IN [{put(name, 'D', 2, '[]::VARCHAR[]')}, {', '.join(stays)}] IF x IS NOT NULL])[1]"


def _inserted(state: int, p: str) -> str:
    """SQL: the same with at most one more insertion before; p: prefix of what it leads to."""
    after = conversations.AFTER[state]
    a, role = "esua"[after], conversations.NAMES[after]
    return f"list_sort([b{'esua'[state]}, {{'c': {p}{a}.c + 5, 'a': 'I' || {p}{a}.a, 'm': ['{role}:'] || {p}{a}.m}}])[1]"


ORACLES: dict[str, str] = {
    "op1_risk_controlled_rules": rf"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
        w AS (SELECT rid, [x FOR x IN regexp_split_to_array(text, '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM d),
        tri AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM w, unnest(range(1, len(w) - 1)) u(i)),
        dup AS (SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, t) > 1),
        cov AS (SELECT rid, count(DISTINCT p) AS n FROM dup, unnest([i, i + 1, i + 2]) u(p) GROUP BY 1),
        li AS (SELECT rid, count(*) AS n, count(DISTINCT l) AS nd FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
        f AS (SELECT d.rid, d.doc_id, d.lang, len(w.w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
            coalesce(li.n - li.nd, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(li.n, 0)::BIGINT AS n_lines FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN li USING (rid)),
        g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols / greatest(word_chars, 1) AS symbol_share, n_dup_lines / greatest(n_lines, 1) AS dup_line_share, n_repeat_words / greatest(n_words, 1) AS repeat_share FROM f),
        lb AS (SELECT doc_id, max(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
        h0 AS (SELECT g.*, lb.good FROM g JOIN lb USING (doc_id) WHERE NOT base_failed),
        h AS (SELECT lang AS stratum, good, symbol_share, dup_line_share, repeat_share FROM h0),
        v AS (SELECT stratum, good, unnest(['symbol_share', 'dup_line_share', 'repeat_share']) AS rule, unnest([symbol_share, dup_line_share, repeat_share]) AS value FROM h),
        k AS (SELECT stratum, v.rule, step, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS n_bad, count(*) FILTER (good AND value > cutoff) AS k, count(*) FILTER (NOT good AND value > cutoff) AS k_bad FROM v JOIN (VALUES {_GRID}) q(rule, step, cutoff) ON q.rule = v.rule GROUP BY ALL),
        p AS (SELECT *, CASE WHEN k > n * {_P} THEN 1 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_P}) + (n - j) * ln(1 - {_P}))) FROM range(0, k + 1) r(j)) END AS pv, (SELECT count(DISTINCT coalesce(stratum, chr(0))) FROM h) AS strata FROM k),
        t AS (SELECT *, sum((pv > {quality.DELTA} / (strata * {len(_RULES)}))::INT) OVER (PARTITION BY stratum, rule ORDER BY step) AS failed FROM p),
        c AS (SELECT stratum, rule, max_by(cutoff, step) AS cutoff FROM t WHERE failed = 0 AND n_bad > 0 AND k_bad * (n + 1) >= {quality.LIFT} * (k + 1) * n_bad GROUP BY ALL),
        cw AS (SELECT stratum, {", ".join(f"max(cutoff) FILTER (rule = '{r}') AS {r}_cutoff" for r in _RULES)} FROM c GROUP BY 1)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(f"NOT coalesce({r} > {r}_cutoff, false)" for r in _RULES)} AS kept,
            {", ".join(_RULES)}, {", ".join(f"{r}_cutoff" for r in _RULES)} FROM g LEFT JOIN cw ON cw.stratum IS NOT DISTINCT FROM g.lang""",
    "op2_prefix_shards": f"""
        WITH t AS (SELECT {_crc_table()}::BIGINT[] AS t), b AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
        c AS (SELECT doc_id, strlen(text)::BIGINT + 8 AS size, xor(list_reduce([4294967295] || [('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(encode(text)), '..')], lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b CROSS JOIN t),
        s AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM c),
        h AS (SELECT *, least(23, (2 * before + size) * 24 // (2 * total))::INT AS shard FROM s)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, NULL::INT AS grown_shard FROM h""",
    "op3_tree_merge_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g USING (t)""",
    "op7_mixture": r"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS digest,
              row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, ''))) - 1 AS k FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM d GROUP BY source),
        o AS (SELECT *, 2.0::DOUBLE * source_size / w AS stop, sum(2.0::DOUBLE * source_size) OVER a - 2.0::DOUBLE * source_size AS held, sum(w) OVER () - (sum(w) OVER a - w) AS open, sum(source_size) OVER () AS total
              FROM s WINDOW a AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
        l AS (SELECT (1.5::DOUBLE * total - held) / open AS level FROM o WHERE (1.5::DOUBLE * total - held) / open <= stop ORDER BY stop, source NULLS LAST LIMIT 1),
        t AS (SELECT source, source_size, least(w * level, 2.0::DOUBLE * source_size) AS target FROM s, l),
        r AS (SELECT d.doc_id, d.size, d.digest, d.k, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + (('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null') || '|' || digest || '|' || k), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE < rate - floor(rate))::BIGINT) AS taken FROM r""",
    "op11_importance_resampling": rf"""
        WITH k AS (SELECT {_crc_table()}::BIGINT[] AS k),
        d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
        dw AS (SELECT rid, unnest(w) AS w FROM d),
        v AS (SELECT w, xor(list_reduce([4294967295] || [('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(encode(w)), '..')], lambda a, x: xor(a >> 8, k[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM b) CROSS JOIN k),
        s AS (SELECT bucket, count(*) AS s FROM dw JOIN v USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM b JOIN v USING (w) GROUP BY 1),
        a AS (SELECT (SELECT count(*) FROM dw) AS alls, (SELECT count(*) FROM b) AS allt),
        g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (alls + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (allt + 10000)::DOUBLE)))::BIGINT AS gain FROM (SELECT DISTINCT bucket FROM v) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket) CROSS JOIN a),
        m AS (SELECT rid, sum(gain)::BIGINT AS total, count(*) AS n FROM dw JOIN v USING (w) JOIN g USING (bucket) GROUP BY 1),
        c AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (rid)),
        e AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM c),
        r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS r, 10 * count(*) OVER (PARTITION BY n_features >= 20) // 100 AS drawn FROM e)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= drawn THEN r END AS rank FROM r""",
    "op12_conversation_repair": rf"""
        WITH RECURSIVE k AS (SELECT {_crc_table()}::BIGINT[] AS k),
        c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
        h AS (SELECT *, xor(list_reduce([4294967295] || [('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(encode(name)), '..')], lambda a, x: xor(a >> 8, k[(xor(a, x) & 255) + 1])), 4294967295) % 20 AS code FROM c CROSS JOIN k),
        d AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM h, unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last, left(role, 1) AS ini FROM d),
        f AS (SELECT *, last = '' AS is_blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM o),
        g AS (SELECT *, CASE WHEN is_blank OR again THEN 'must' WHEN last IN ('.', '!', '?') THEN 'none' ELSE 'cut' END AS fault, CASE WHEN last IN ('.', '!', '?') THEN 0 ELSE 5 END AS stays,
            i > 1 AND lag(ini) OVER w || ini NOT IN ('su', 'ua', 'au') AS bad FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
        r AS (SELECT conv_id, n + 1 AS i, {{'c': 0, 'a': '', 'm': []::VARCHAR[]}} AS e, {{'c': 10, 'a': 'II', 'm': ['user:', 'assistant:']}} AS s, {{'c': 5, 'a': 'I', 'm': ['assistant:']}} AS u, {{'c': 0, 'a': '', 'm': []::VARCHAR[]}} AS a FROM g WHERE i = n
            UNION ALL SELECT conv_id, i, {", ".join(_inserted(x, "i") + f" AS {'esua'[x]}" for x in range(4))} FROM (
            SELECT *, {", ".join(_inserted(x, "b") + f" AS i{'esua'[x]}" for x in range(4))} FROM (
            SELECT g.conv_id, g.i, {", ".join(_edits(x) + f" AS b{'esua'[x]}" for x in range(4))} FROM r JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.i = r.i - 1))),
        t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank, count(*) FILTER (NOT is_blank AND again) AS duplicate, count(*) FILTER (fault = 'cut') AS truncated, count(*) FILTER (bad) AS illegal FROM g GROUP BY 1)
        SELECT x.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.c, 0)::BIGINT AS cost, coalesce(e.a, '') AS audit,
            sha256(coalesce(array_to_string(e.m, chr(10)), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM x.conv_id AND r.i = 1""",
    "op13_warc_packages": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        q AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS r, first(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS f FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes < 100 OR r = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN payload_bytes >= 100 AND r > 1 THEN f END AS refers_to FROM q""",
}
