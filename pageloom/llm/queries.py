"""The thin queries over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations


import public_tokenizers
from pyspark.sql import functions as F

from pageloom.llm import cover_tree, decontamination, html_extract, licenses, line_dedup, mixing, ngram_join, token_counts, token_output, toxicity
from pageloom.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


@query(
    """WITH l AS (SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY 1),
d AS (SELECT k.*, coalesce(k.doc_id > f.first, false) AS dropped FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256 FROM d GROUP BY 1"""
)
def op2_line_dedup(spark, d):
    docs = table(spark, d, "documents")
    return line_dedup.kept_digests(docs, line_dedup.keep_bitmaps(docs))


@query()
def op3_token_counts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query()
def op4_token_output(spark, d):
    return token_output.token_output(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op6_ngram_join(spark, d):
    return ngram_join.ngram_groups(table(spark, d, "documents"))


@query()
def op7_decontamination(spark, d):
    return decontamination.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


_P = f"{mixing.PERIOD}"
MIX_SQL = f"""WITH RECURSIVE docs AS (SELECT doc_id, coalesce(source, '') AS source FROM documents),
sizes AS (SELECT source, count(*) AS n, CAST(ceil(count(*) / {mixing.BLOCK_DOCS}) AS BIGINT) AS blocks FROM docs GROUP BY 1),
quota AS (SELECT source, n, blocks, pow(n::DOUBLE, {mixing.ALPHA}) / sum(pow(n::DOUBLE, {mixing.ALPHA})) OVER () * ({_P} - count(*) OVER ()) AS q FROM sizes),
ranked AS (SELECT *, row_number() OVER (ORDER BY floor(q) - round(q, 9), source) AS r, {_P} - sum(floor(q) + 1) OVER () AS spare FROM quota),
weights AS (SELECT source, blocks, CAST(floor(q) + 1 + CASE WHEN r <= spare THEN 1 ELSE 0 END AS BIGINT) AS share, row_number() OVER (ORDER BY source) AS i FROM ranked),
w AS (SELECT list(share ORDER BY i) AS shares FROM weights),
pick AS (SELECT 0 AS t, shares, list_transform(shares, lambda x: 0::BIGINT) AS done, 0::BIGINT AS p FROM w
 UNION ALL SELECT t + 1, shares, list_transform(done, lambda x, j: CASE WHEN j = c THEN x + 1 ELSE x END), c FROM (SELECT *, list_min(list_transform(list_filter(range(1, len(shares) + 1),
  lambda j: done[j] < shares[j] AND floor(done[j] * {_P} / shares[j]) <= t), lambda j: struct_pack(deadline := CAST(ceil((done[j] + 1) * {_P} / shares[j]) AS BIGINT), j := j))).j AS c FROM pick WHERE t < {_P})),
slots AS (SELECT t - 1 AS slot, source, share, blocks, row_number() OVER (PARTITION BY source ORDER BY t) - 1 AS k FROM pick JOIN weights ON i = p WHERE t > 0),
fin AS (SELECT max(CAST((blocks - 1) // share AS BIGINT) * {_P} + slot) AS fin FROM slots WHERE (blocks - 1) % share = k),
drawn AS (SELECT source, any_value(blocks) AS blocks, any_value(share) AS share, sum(CASE WHEN slot <= fin THEN (fin - slot) // {_P} + 1 ELSE 0 END)::BIGINT AS draws FROM slots, fin GROUP BY 1),
placed AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM docs),
blocked AS (SELECT p.*, place // {mixing.BLOCK_DOCS} AS block, blocks, share, draws FROM placed p JOIN drawn USING (source)),
turns AS (SELECT *, unnest(range(0, CAST(ceil((draws - block) / blocks) AS BIGINT))) AS epoch FROM blocked)
SELECT doc_id, t.source, place, block, epoch, ((epoch * t.blocks + block) // t.share) * {_P} + slot AS slot FROM turns t JOIN slots s ON s.source = t.source AND s.k = (epoch * t.blocks + block) % t.share"""


@query(MIX_SQL)
def op10_mixing(spark, d):
    return mixing.schedule(table(spark, d, "documents").select("doc_id", "source"))


_Q = lambda x: "'" + x.replace("'", "''") + "'"
_T = ", ".join(f"({_Q(k)}, {i}, {_Q(w)})" for k, ws in licenses.TEMPLATES.items() for i, w in enumerate(ws))
_PARTS = f"regexp_split_to_array(text, {_Q('\\n[ \\t/#*;-]*\\n')})"


@query(
    f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, array_to_string(list_concat([coalesce(source, '-')], list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: left(CAST(doc_id AS VARCHAR), i))), '/') AS path FROM documents),
signed AS (SELECT * FROM docs WHERE regexp_matches(text, '{licenses.SIGNS}')),
heads AS (SELECT doc_id, path, unnest(list_concat(list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{licenses.SIGNS}')), lambda x: CASE WHEN regexp_matches(x, '{licenses.SPDX}')
  THEN 'spdx' || regexp_replace(regexp_replace(lower(regexp_extract(x, '{licenses.SPDX}', 1)), '-or-later$|-only$|[+]$', ''), '[^a-z0-9]', '', 'g') ELSE trim(x, ' ') END),
 list_transform(list_filter({_PARTS}, lambda x: contains(x, chr(10)) AND regexp_matches(x, '{licenses.SIGNS}')), lambda x: trim(x, ' ')),
 CASE WHEN regexp_matches(text, '{licenses.BODY}') AND len({_PARTS}) > 1 THEN [trim(text, ' ')] ELSE CAST([] AS VARCHAR[]) END)) AS line FROM signed),
lines AS (SELECT line, count(*) AS n FROM heads GROUP BY 1), total AS (SELECT coalesce(sum(n), 0)::DOUBLE AS total FROM lines),
tf AS (SELECT line, term, count(*) AS tf, any_value(n) AS n FROM (SELECT line, n, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS term FROM lines) GROUP BY 1, 2),
df AS (SELECT term, sum(n) AS df FROM tf GROUP BY 1), t(licence, i, wording) AS (VALUES {_T}),
words AS (SELECT licence, i, term, count(*) * (1 + ln((1.0 + total) / (1 + coalesce(any_value(df), 0)))) AS wt FROM (SELECT licence, i, unnest(regexp_extract_all(lower(wording), '[a-z0-9]+')) AS term FROM t) LEFT JOIN df USING (term), total GROUP BY licence, i, term, total),
weighed AS (SELECT line, term, tf * (1 + ln((1.0 + total) / (1 + df))) AS wl FROM tf JOIN df USING (term), total),
scored AS (SELECT line, licence, round(dot / (nl * nt), 6) AS cosine FROM (SELECT line, licence, i, sum(wl * wt) AS dot FROM weighed JOIN words USING (term) GROUP BY 1, 2, 3)
 JOIN (SELECT line, sqrt(sum(wl * wl)) AS nl FROM weighed GROUP BY 1) USING (line) JOIN (SELECT licence, i, sqrt(sum(wt * wt)) AS nt FROM words GROUP BY 1, 2) USING (licence, i)),
found AS (SELECT * FROM scored WHERE cosine >= {licenses.LEAST} QUALIFY row_number() OVER (PARTITION BY line ORDER BY cosine DESC, licence) = 1),
own AS (SELECT doc_id, path, licence, cosine FROM heads JOIN found USING (line) QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY cosine DESC, licence) = 1),
ruled AS (SELECT array_to_string(string_split(path, '/')[:-2], '/') AS dir, licence, cosine FROM own QUALIFY row_number() OVER (PARTITION BY dir ORDER BY NOT regexp_matches(path, '{licenses.LICENCE_FILE}'), doc_id) = 1),
up AS (SELECT d.doc_id, d.path, array_to_string(list_slice(s, 1, i), '/') AS dir FROM (SELECT doc_id, path, string_split(path, '/') AS s, unnest(range(0, len(string_split(path, '/')))) AS i FROM docs) d),
near AS (SELECT doc_id, path, dir, licence, cosine FROM up JOIN ruled USING (dir) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(dir) DESC) = 1)
SELECT d.doc_id, d.path, coalesce(o.licence, n.licence) AS licence, coalesce(o.cosine, n.cosine) AS cosine, CASE WHEN o.licence IS NOT NULL THEN 'own' WHEN n.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
 CASE WHEN o.licence IS NULL THEN n.dir END AS from_dir FROM docs d LEFT JOIN own o ON o.doc_id = d.doc_id LEFT JOIN near n ON n.doc_id = d.doc_id"""
)
def op1_license_scan(spark, d):
    docs = table(spark, d, "documents")
    return licenses.licences(docs.select("doc_id", licenses.digit_path(F.col("source"), F.col("doc_id")).alias("path"), "text"))


@query()
def op5_embedding_dedup(spark, d):
    return cover_tree.near_vectors(table(spark, d, "embeddings").select("vec_id", "label", "embedding"))


@query()
def op9_toxicity(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, table(spark, d, "labels"), ["quality", "toxic"])
    return toxicity.score(docs, chain).withColumn("toxic", F.col("p_toxic") >= 0.5)


@query()
def op8_html_extraction(spark, d):
    out = html_extract.extract(table(spark, d, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
