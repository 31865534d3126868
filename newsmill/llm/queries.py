"""The operators' registered queries over the given tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsmill.llm import (
    block_names, decontaminate, divergence, main_text, mixing, quote_links, simhash, site_spread, suffix_repeats,
    token_counts, toxicity, turn_repair, window_repeats,
)
from newsmill.llm.common import UPPER, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"


@query("op4_simhash_bk_trees")
def op4(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents")).drop("links")


@query(
    "op8_block_names",
    f"""
    WITH t AS (SELECT doc_id, sha256({LOWERED}) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM t WINDOW w AS (PARTITION BY text_sha256)
    """,
)
def op8(spark, sf):
    return block_names.exact_duplicates(table(spark, sf, "documents")).drop("level", "name")


@query("op9_token_counts")
def op9(spark, sf):
    from public_tokenizers import path

    return token_counts.token_counts(table(spark, sf, "documents"), path("byte_bpe_50k.json"))


LINE = f"trim({LOWERED.replace('text', 'line')}, ' ' || chr(9) || chr(13) || chr(11) || chr(12))"


@query(
    "op2_site_spread",
    f"""
    WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
         l AS (SELECT doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
         k AS (SELECT doc_id, source, line, pos, {LINE} AS same FROM l),
         b AS (SELECT same FROM k WHERE same <> '' GROUP BY same HAVING count(DISTINCT source) >= 10),
         f AS (SELECT k.*, b.same IS NOT NULL AS gone FROM k LEFT JOIN b USING (same))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM f GROUP BY doc_id
    """,
)
def op2(spark, sf):
    kept = site_spread.remove_boilerplate(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op3_toxicity_nnpu")
def op3(spark, sf):
    docs = table(spark, sf, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf, "labels")))


@query("op6_suffix_repeats")
def op6(spark, sf):
    return suffix_repeats.remove_repeats(table(spark, sf, "documents"), with_kept=False).drop("spans")


@query("op7_window_doubling")
def op7(spark, sf):
    return window_repeats.remove_windows(table(spark, sf, "documents"), with_kept=False).drop("spans")


@query("op1_cgk_decontamination")
def op1(spark, sf):
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


DOMAIN = "coalesce(try_cast(regexp_extract(source, '[0-9]+$', 0) AS int), 0) % 4"
WEIGHTS = {
    "domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1},
    "lang": {"en": 3, "de": 2, "fr": 2},
}


LEVELS = {
    "domain": lambda: F.concat(F.lit("d"), F.expr(DOMAIN).cast("string")),
    "lang": lambda: F.col("lang"),
    "source": lambda: F.col("source"),
}


def mixture(docs):
    return mixing.mix(docs, {name: level() for name, level in LEVELS.items()}, WEIGHTS)


def _case(level):
    return "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {float(v)}" for k, v in WEIGHTS.get(level, {"": 1}).items()) + " ELSE 1.0 END"


def _fill(source, path, budget):
    parents = ", ".join(path[:-1]) or "1"
    return f"""
      (WITH n AS ({source}),
            o AS (SELECT *, coalesce(sum(capacity) OVER (PARTITION BY {parents} ORDER BY capacity / weight, {path[-1]}
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                            + capacity / weight * sum(weight) OVER (PARTITION BY {parents} ORDER BY capacity / weight, {path[-1]}
                              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= {budget} AS filled FROM n)
       SELECT {', '.join(path)}, CAST(CASE WHEN filled THEN capacity ELSE floor(weight *
              (({budget} - coalesce(sum(capacity) FILTER (filled) OVER (PARTITION BY {parents}), 0))
               / sum(weight) FILTER (NOT filled) OVER (PARTITION BY {parents}))) END AS BIGINT) AS budget FROM o)"""


def _nodes(path, above):
    names = ", ".join(path)
    summed = f"SELECT {names}, CAST(sum(tokens) * 2 AS BIGINT) AS capacity, {_case(path[-1])} AS weight FROM leaves GROUP BY ALL"
    if not above:
        return f"SELECT *, (SELECT b FROM total) AS budget FROM ({summed})"
    return f"SELECT * FROM ({summed}) JOIN {above} USING ({', '.join(path[:-1])})"


MIX_SQL = f"""
    WITH d AS (SELECT doc_id, 'd' || ({DOMAIN.replace(", 0) AS", ") AS")}) AS domain, coalesce(lang, '') AS lang,
                      coalesce(source, '') AS source,
                      len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
         docs AS (SELECT * FROM d WHERE n_tokens > 0),
         leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM docs GROUP BY ALL),
         total AS (SELECT CAST(floor(sum(tokens) * 0.5) AS BIGINT) AS b FROM leaves),
         g1 AS {_fill(_nodes(["domain"], None), ["domain"], "budget")},
         g2 AS {_fill(_nodes(["domain", "lang"], "g1"), ["domain", "lang"], "budget")},
         g3 AS {_fill(_nodes(["domain", "lang", "source"], "g2"), ["domain", "lang", "source"], "budget")},
         g AS (SELECT *, CAST(budget // tokens AS BIGINT) AS whole, budget - (budget // tokens) * tokens AS rest
               FROM leaves JOIN g3 USING (domain, lang, source) WHERE budget > 0),
         p AS (SELECT docs.*, whole, rest,
                      coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
                        ORDER BY md5('42:' || whole || ':' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
               FROM docs JOIN g USING (domain, lang, source))
    SELECT doc_id, e.epoch, domain, lang, source, n_tokens, n_tokens AS taken
    FROM p, LATERAL (SELECT unnest(range(whole)) AS epoch) e
    UNION ALL
    SELECT doc_id, whole, domain, lang, source, n_tokens, CAST(least(n_tokens, rest - start) AS BIGINT)
    FROM p WHERE start < rest
    """


@query("op5_hierarchical_mixing", MIX_SQL)
def op5(spark, sf):
    return mixture(table(spark, sf, "documents")).drop("_id", "_hash")


NORMAL = "trim(regexp_replace({}, '[ \\t\\r\\n\\x0b\\x0c]+', ' ', 'g'))"
LOWERED_TEXT = f"translate({{}}, '{UPPER}', '{UPPER.lower()}')"

QUOTE_SQL = f"""
    WITH RECURSIVE
    mail AS (SELECT a.conv_id, a.turn, a.role, concat_ws(chr(10),
                    '> > ' || replace(c.text, chr(10), chr(10) || '> > '),
                    '> ' || replace(b.text, chr(10), chr(10) || '> '), '', a.text) AS text
             FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1
             LEFT JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.turn - 2),
    s AS (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM mail),
    u AS (SELECT conv_id, turn, unnest(l) AS raw, generate_subscripts(l, 1) AS pos FROM s),
    lines AS (SELECT conv_id, turn, pos,
                     len(regexp_replace(regexp_extract(raw, '^([ \\t]*>)+'), '[^>]', '', 'g')) AS level,
                     regexp_replace(raw, '^([ \\t]*>)+[ \\t]?', '') AS line FROM u),
    marked AS (SELECT *, {NORMAL.format("line")} = '' AS blank,
                      lag(level) OVER w AS before, lag({NORMAL.format("line")} = '') OVER w AS gap
               FROM lines WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos)),
    runs AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> level OR gap THEN 1 ELSE 0 END)
                       OVER (PARTITION BY conv_id, turn ORDER BY pos) AS run FROM marked),
    pass AS (SELECT conv_id, turn, level, min(pos) AS pos, string_agg(line, chr(10) ORDER BY pos) AS text
             FROM runs WHERE NOT blank GROUP BY conv_id, turn, level, run),
    hashed AS (SELECT *, md5({NORMAL.format(LOWERED_TEXT.format("text"))}) AS h FROM pass),
    own AS (SELECT conv_id, h, min(turn) AS quoted FROM hashed WHERE level = 0 GROUP BY ALL),
    par AS (SELECT q.conv_id, q.turn, max(quoted) AS parent FROM hashed q JOIN own USING (conv_id, h)
            WHERE level = 1 AND quoted < q.turn GROUP BY ALL),
    tree AS (SELECT conv_id, turn, NULL::BIGINT AS parent_turn, turn AS root_turn, 0 AS depth FROM mail
             WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM par)
             UNION ALL
             SELECT par.conv_id, par.turn, par.parent, root_turn, depth + 1
             FROM tree JOIN par ON par.conv_id = tree.conv_id AND par.parent = tree.turn),
    words AS (SELECT conv_id, turn, string_agg(text, chr(10) || chr(10) ORDER BY pos) FILTER (level = 0) AS text,
                     count(*) FILTER (level > 0) AS n_quotes, max(level) AS deepest FROM pass GROUP BY ALL)
    SELECT mail.conv_id, mail.turn, role, coalesce(words.text, '') AS text, coalesce(n_quotes, 0) AS n_quotes,
           coalesce(deepest, 0) AS deepest, parent_turn, root_turn, CAST(depth AS BIGINT) AS depth
    FROM mail JOIN tree USING (conv_id, turn) LEFT JOIN words USING (conv_id, turn)
    """


@query("op10_quote_links", QUOTE_SQL)
def op10(spark, sf):
    return quote_links.reply_order(quote_links.with_quotes(table(spark, sf, "conversations")))


SHARE = "1 + 1000000000::HUGEINT * ({} + 2) // ({} + 2 * v)"
DIFFER = "((p - q) * (p - q)) // (p + q)"

DIVERGENCE_SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all({LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents),
         o AS (SELECT row, lang, source, unnest(found) AS term FROM d),
         kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM o GROUP BY ALL HAVING count(DISTINCT row) >= 10),
         c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
         langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY ALL),
         g AS (SELECT lang, source, coalesce(total, 0) AS total
               FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL)
               USING (lang, source)),
         p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, {SHARE.format("coalesce(c.n, 0)", "g.total")} AS p,
                      {SHARE.format("kept.n", "langs.total")} AS q
               FROM g JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN c
               ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
         sums AS (SELECT lang, source, item, sum({DIFFER}) AS value
                  FROM (SELECT a.lang, a.source, b.source AS item, a.p, b.p AS q
                        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source) GROUP BY ALL),
         pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
                   FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                   LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
         parts AS (SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs
                   UNION ALL SELECT lang, source, 'term', term, CAST({DIFFER} AS BIGINT) FROM p WHERE n > 0 AND p > q)
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM parts
    QUALIFY part = 'pair' OR rank <= 10
    """


@query("op13_count_cells", DIVERGENCE_SQL)
def op13(spark, sf):
    return divergence.source_audit(table(spark, sf, "documents"))


@query("op12_turn_repair")
def op12(spark, sf):
    return turn_repair.repair_damaged(table(spark, sf, "conversations"))


@query("op11_minimum_cut")
def op11(spark, sf):
    return main_text.extract(table(spark, sf, "pages"))
