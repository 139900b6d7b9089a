"""The operators as queries over the test tables, with SQL where it can express them."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewire.llm.bpe import token_digests
from tapewire.llm.contamination import find_items
from tapewire.llm.exact_dedup import duplicate_groups
from tapewire.llm.infill import infill_digests
from tapewire.llm.language import identify_languages
from tapewire.llm.line_dedup import dedup_lines
from tapewire.llm.manifest import verified_manifest
from tapewire.llm.quality import score_quality
from tapewire.llm.secrets import secret_digests
from tapewire.llm.sharding import shard_documents
from tapewire.llm.simhash import near_groups
from tapewire.llm.substring_dedup import remove_repeats
from tapewire.llm.toxicity import score_toxicity

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query()
def op1_bpe_encode_decode(spark, sf_dir):
    return token_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query(r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len,
                  regexp_replace(coalesce(text, ''), '[ \t-\r]+', '', 'g') AS content FROM documents),
     g AS (SELECT content, arg_max(doc_id, len::HUGEINT * 100000000000000000000::HUGEINT - doc_id) AS keep_id,
                  count(*)::BIGINT AS group_size FROM n GROUP BY content)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256
FROM n JOIN g USING (content)""")
def op2_exact_dedup(spark, sf_dir):
    return duplicate_groups(documents(spark, sf_dir))


@query()
def op4_sharding(spark, sf_dir):
    return shard_documents(documents(spark, sf_dir))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
     s AS (SELECT doc_id, line, pos, regexp_replace(regexp_replace(line, '^[ \t-\r]+', ''), '[ \t-\r]+$', '') AS t FROM l),
     k AS (SELECT doc_id, line, pos, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM s),
     f AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
     j AS (SELECT k.doc_id, line, pos, coalesce(k.doc_id <> f.last_doc, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""")
def op5_line_dedup(spark, sf_dir):
    return dedup_lines(documents(spark, sf_dir)).select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


@query()
def op6_simhash_near_dedup(spark, sf_dir):
    return near_groups(documents(spark, sf_dir))


@query(r"""
WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+') IF x <> ''] AS ws FROM documents),
     s AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
     k AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM s),
     m AS (SELECT win, min(doc_id) AS low FROM k GROUP BY win HAVING min(doc_id) < max(doc_id)),
     c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM k JOIN m USING (win) WHERE doc_id > low),
     p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
     j AS (SELECT p.doc_id, p.pos, word, c.pos IS NOT NULL AS gone FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.pos = c.pos),
     g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS r, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept
           FROM j GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN g USING (doc_id)""")
def op3_substring_dedup(spark, sf_dir):
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op10_language_id(spark, sf_dir):
    return identify_languages(documents(spark, sf_dir))


_WORD_LIST = r"""[x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+') IF x <> '']"""


@query(f"""
WITH d AS (SELECT doc_id, {_WORD_LIST} AS ws FROM documents),
     b AS (SELECT item_id, {_WORD_LIST} AS ws FROM benchmark),
     ds AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
     bs AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
     n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
     m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM m JOIN n USING (item_id) WHERE n_shared * 5 >= n_item * 4""")
def op8_benchmark_decontamination(spark, sf_dir):
    return find_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query()
def op7_quality_classifier(spark, sf_dir):
    return score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query()
def op9_toxicity(spark, sf_dir):
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query()
def op11_secret_scans(spark, sf_dir):
    return secret_digests(documents(spark, sf_dir))


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a text of ASCII characters."""
    bit = "xor(x >> 1, 3988292384::UBIGINT * (x & 1))"
    byte = f"list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, _: {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::UBIGINT)"
    return f"xor(list_reduce(list_concat([4294967295]::UBIGINT[], CASE WHEN {text} = '' THEN [] ELSE {codes} END), lambda a, c: {byte}), 4294967295::UBIGINT)"


def _manifest_sql(height: int = 8, over: int = 4) -> str:
    """Levels of a fan of 16 written out: ``height`` within a source, ``over`` above the sources."""

    def field(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return f"sha256({field('doc_id')} || {field('source')} || {field('lang')} || {field('n_chars')} || {field(text)})"

    def levels(name: str, n: int) -> str:
        """Runs of each level (r) and the nodes above them (n), where a tree has more than one node."""
        return "".join(
            f""",
{name}r{k} AS (SELECT src, pos // 16 AS run, list(digest ORDER BY pos) AS digests FROM {name}n{k}
        WHERE src IN (SELECT src FROM {name}n{k} GROUP BY src HAVING count(*) > 1) GROUP BY src, pos // 16),
{name}n{k + 1} AS (SELECT src, run AS pos, sha256(array_to_string(digests, '')) AS digest FROM {name}r{k})"""
            for k in range(n)
        )

    def climb(name: str, rows: str, n: int) -> str:
        """Rows (src, pos, proof, node) taken up the levels."""
        out, last = "", rows
        for k in range(n):
            others = "digests[1 : pos % 16] || digests[pos % 16 + 2 :]"
            out += f""",
{name}c{k} AS (SELECT c.* REPLACE (CASE WHEN run IS NULL THEN c.pos ELSE c.pos // 16 END AS pos,
        CASE WHEN run IS NULL THEN proof ELSE proof || array_to_string({others}, '') END AS proof,
        CASE WHEN run IS NULL THEN node ELSE sha256(array_to_string(digests[1 : pos % 16] || [node] || digests[pos % 16 + 2 :], '')) END AS node)
        FROM {last} c LEFT JOIN {name}r{k} r ON c.src = r.src AND c.pos // 16 = r.run)"""
            last = f"{name}c{k}"
        return out

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') "
    tops = " UNION ALL ".join(f"SELECT src, digest FROM sn{k} QUALIFY count(*) OVER (PARTITION BY src) = 1" for k in range(height + 1))
    roots = " UNION ALL ".join(f"SELECT digest FROM tn{k} QUALIFY count(*) OVER () = 1" for k in range(over + 1))
    return f"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS src, {leaf("text")} AS leaf,
             CASE WHEN {_crc32("coalesce(doc_id::VARCHAR, '')")} % 5 = 0 THEN {leaf(lower)} END AS given FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
sn0 AS (SELECT src, pos, leaf AS digest FROM p){levels("s", height)},
subs AS (SELECT src, digest, row_number() OVER (ORDER BY src) - 1 AS pos FROM ({tops})),
tn0 AS (SELECT '' AS src, pos, digest FROM subs){levels("t", over)},
roots AS ({roots}),
s AS (SELECT doc_id, leaf, src, pos, '' AS proof, coalesce(given, leaf) AS node FROM p){climb("s", "s", height)},
t AS (SELECT doc_id, leaf, '' AS src, subs.pos, subs.digest AS subroot, proof, node FROM sc{height - 1} c JOIN subs ON c.src = subs.src){climb("t", "t", over)}
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = digest AS verified FROM tc{over - 1}, roots"""


@query(_manifest_sql())
def op12_merkle_manifest(spark, sf_dir):
    return verified_manifest(documents(spark, sf_dir))


@query(r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
     u AS (SELECT doc_id, text, CASE WHEN text = '' THEN [] ELSE regexp_extract_all(text, '[ 	-]*[^ 	-]+|[ 	-]+') END AS u,
                  ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
     f AS (SELECT doc_id, text, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
                  CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
     p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p""")
def op13_fill_in_middle(spark, sf_dir):
    return infill_digests(documents(spark, sf_dir))
