"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers

from millrace.llm.bpe import round_trip_digests
from millrace.llm.exact_dedup import exact_dedup
from millrace.llm.fingerprint import compare_with_next
from millrace.llm.langid import predict_languages
from millrace.llm.licences import licence_labels, scan_licences
from millrace.llm.line_templates import drop_recurring_lines
from millrace.llm.merkle import manifest_digests
from millrace.llm.mixing import mix
from millrace.llm.near_dedup import near_duplicates
from millrace.llm.periodic_runs import periodic_runs, run_digests, with_repeated_tails
from millrace.llm.pii import find_personal_data
from millrace.llm.sentence_spans import drop_repeated_spans
from millrace.llm.warc import archive_round_trip
from millrace.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


@_query(
    "op6_exact_dedup",
    """
WITH k AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                           'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256, 1::BIGINT AS copies
FROM k WINDOW w AS (PARTITION BY text_sha256)
""",
)
def op6(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


#: The vocabulary that op3 and the pipeline encode with.
TOKENIZER = "byte_bpe_50k.json"


@_query("op3_bpe")
def op3(spark, sf_dir):
    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@_query("op4_language_id")
def op4(spark, sf_dir):
    return predict_languages(table(spark, sf_dir, "documents"))


@_query("op1_fingerprints")
def op1(spark, sf_dir):
    return compare_with_next(table(spark, sf_dir, "documents"))


@_query("op9_personal_data")
def op9(spark, sf_dir):
    return find_personal_data(table(spark, sf_dir, "documents"))


@_query(
    "op7_warc",
    """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM q
""",
)
def op7(spark, sf_dir):
    return archive_round_trip(table(spark, sf_dir, "pages"))


@_query("op2_mixing")
def op2(spark, sf_dir):
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "pieces")


@_query(
    "op8_near_dedup",
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
             ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n + b.n) AS n
      FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (n - c)),
d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, d.b FROM r JOIN d ON d.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
""",
)
def op8(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


@_query("op10_sentence_spans")
def op10(spark, sf_dir):
    return drop_repeated_spans(table(spark, sf_dir, "documents"), back=True)


@_query(
    "op5_line_templates",
    r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
m AS (SELECT doc_id, pos, line, regexp_replace(trim(regexp_replace(line, '[ \t\x0B\f\r]+', ' ', 'g'), ' '),
                                              '[^ ]*[0-9][^ ]*', '<*>', 'g') AS masked FROM l),
k AS (SELECT *, string_split(masked, ' ') AS w FROM m WHERE masked <> '' AND len(string_split(masked, ' ')) >= 3),
d AS (SELECT masked, any_value(w) AS w, any_value({'n': len(w), 'a': w[1], 'b': w[2]}) AS leaf,
             count(DISTINCT doc_id) AS docs FROM k GROUP BY masked),
t AS (SELECT masked, leaf, docs, unnest(w) AS token, unnest(range(0, len(w))) AS place FROM d),
f AS (SELECT leaf, place, token FROM t GROUP BY ALL HAVING sum(docs) >= 10),
s AS (SELECT t.masked, list(CASE WHEN f.token IS NOT NULL AND t.token <> '<*>' THEN t.token ELSE '<*>' END
                            ORDER BY t.place) AS shown
      FROM t LEFT JOIN f ON t.leaf = f.leaf AND t.place = f.place AND t.token = f.token GROUP BY t.masked),
p AS (SELECT masked, array_to_string(shown, ' ') AS template FROM s
      WHERE len(list_filter(shown, lambda x: x <> '<*>')) >= 0.6 * len(shown)),
r AS (SELECT template FROM p JOIN k USING (masked) GROUP BY template HAVING count(DISTINCT doc_id) >= 10),
g AS (SELECT doc_id, pos FROM k JOIN p USING (masked) JOIN r USING (template))
SELECT d.doc_id, coalesce(x.text, '') AS text, coalesce(y.n, 0) AS n_dropped FROM documents d
LEFT JOIN (SELECT m.doc_id, string_agg(m.line, chr(10) ORDER BY m.pos) AS text FROM m
           LEFT JOIN g ON g.doc_id = m.doc_id AND g.pos = m.pos WHERE g.pos IS NULL GROUP BY 1) x ON x.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM g GROUP BY 1) y ON y.doc_id = d.doc_id
""",
)
def op5(spark, sf_dir):
    return drop_recurring_lines(table(spark, sf_dir, "documents"))


@_query("op11_merkle_manifest")
def op11(spark, sf_dir):
    return manifest_digests(table(spark, sf_dir, "documents"))


@_query("op12_licence_scan")
def op12(spark, sf_dir):
    return licence_labels(scan_licences(table(spark, sf_dir, "documents")))


@_query("op13_periodic_runs")
def op13(spark, sf_dir):
    return run_digests(periodic_runs(with_repeated_tails(table(spark, sf_dir, "documents"))))


@_query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
