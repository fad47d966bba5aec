"""Queries on search, entropy, similarity and versions, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosswalk.functions import names, values
from crosswalk.operators import catalog, search, similarity, summaries
from crosswalk.plans.tables import table, vectors

QUERIES, SQL = {}, {}

_SCORED = """s AS (SELECT q.vec_id AS q, t.vec_id AS t, round(list_inner_product(q.embedding::DOUBLE[], t.embedding::DOUBLE[]), 6) AS score, t.label FROM embeddings q, embeddings t WHERE q.vec_id % 10 = 0 AND t.vec_id % 10 <> 0)"""
_TOP = _SCORED + """, r AS (SELECT q, t, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, t) AS rank FROM s{where}), k AS (SELECT * FROM r WHERE rank <= {k})"""
_FLOOR = "WITH " + _TOP.format(where="", k=10) + ", f AS (SELECT q, t, score, rank FROM (SELECT *, max(score) OVER (PARTITION BY q) AS top FROM k) WHERE top <= 0 OR score >= top * 0.75)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("WITH " + _TOP.format(where="", k=5) + " SELECT q, t, score, rank FROM k")
def vector_topk(spark, d):
    return search.top_k(*vectors(spark, d), 5)


@query("WITH " + _TOP.format(where=" WHERE label % 2 = 0", k=5) + " SELECT q, t, score, rank FROM k")
def vector_topk_eligible(spark, d):
    return search.top_k(*vectors(spark, d), 5, F.col("label") % 2 == 0)


@query(_FLOOR + " SELECT * FROM f")
def score_floor(spark, d):
    return search.score_floor(search.top_k(*vectors(spark, d), 10), 0.75)


@query(_FLOOR + " SELECT q, count(*) AS candidates, round(CASE WHEN count(*) <= 1 THEN 0 ELSE log2(count(*)) END, 3) AS entropy FROM f GROUP BY q")
def candidate_entropy(spark, d):
    return summaries.candidate_entropy(score_floor(spark, d))


_ENTROPY = _FLOOR + ", e AS (SELECT q, round(CASE WHEN count(*) <= 1 THEN 0 ELSE log2(count(*)) END, 3) AS entropy FROM f GROUP BY q)"


@query(_ENTROPY + " SELECT count(*) AS items, round(sum(entropy), 3) AS total, round(avg(entropy), 3) AS mean, count(*) FILTER (entropy >= 4) AS high FROM e")
def entropy_total(spark, d):
    return summaries.entropy_total(candidate_entropy(spark, d))


@query(_ENTROPY + """ SELECT vec_id AS q, CASE label % 3 WHEN 0 THEN 'best-guess' WHEN 1 THEN 'confident' ELSE 'confident' END AS confidence, coalesce(entropy, 0) AS before,
 CASE WHEN label % 3 = 0 THEN coalesce(entropy, 0) ELSE 0 END AS residual FROM embeddings LEFT JOIN e ON q = vec_id WHERE vec_id % 5 = 0""")
def residual_entropy(spark, d):
    conf = table(spark, d, "embeddings").where("vec_id % 5 = 0").select(F.col("vec_id").alias("q"), F.when(F.col("label") % 3 == 0, "best-guess").when(F.col("label") % 3 == 1, "confident").alias("confidence"), F.lit(0).alias("pos"))
    return summaries.residual(candidate_entropy(spark, d), conf)


@query("""WITH s AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS x, row_number() OVER (PARTITION BY b ORDER BY score DESC, a) AS y FROM s) SELECT a, b, round(score, 6) AS score FROM f WHERE x = 1 AND y = 1""")
def mutual_nn(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    a, b = v.where("id % 2 = 0"), v.where("id % 2 = 1")
    return search.mutual(search.top_k(a, b, 1), search.top_k(b, a, 1))


@query("""SELECT p_partkey, p_brand, p_name, CASE WHEN count(*) OVER (PARTITION BY p_brand, p_name) > 1 THEN p_name || ' [' || row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) || ']' ELSE p_name END AS display FROM part""")
def dup_id_numbering(spark, d):
    return search.number_duplicates(table(spark, d, "part").select("p_partkey", "p_brand", "p_name"), ["p_brand"], "p_name", ["p_partkey"])


@query("""SELECT * FROM (SELECT p_brand || ':' || p_name AS qname, p_partkey AS pos, CASE WHEN lower(p_name) = 'ring' THEN 0 WHEN starts_with(lower(p_name), 'ring') THEN 1 WHEN contains(lower(p_brand || ':' || p_name), 'ring') THEN 2 WHEN contains(lower(p_type), 'ring') THEN 3 END AS match FROM part)
WHERE match IS NOT NULL ORDER BY match, pos LIMIT 20""")
def catalog_search(spark, d):
    rows = table(spark, d, "part").select(F.concat("p_brand", F.lit(":"), "p_name").alias("qname"), F.col("p_name").alias("local"), F.col("p_type").alias("definition"), F.col("p_partkey").alias("pos"))
    return search.search_catalog(rows, "ring").select("qname", "pos", "match")


@query("""WITH n AS (SELECT s_name AS name FROM supplier UNION ALL SELECT c_name FROM customer), k AS (SELECT name, CASE WHEN name = '00000012' THEN 1 WHEN ends_with(name, '00000012') THEN 2 WHEN ends_with(lower(name), '00000012') THEN 3 END AS kind FROM n)
SELECT name, kind FROM k WHERE kind = (SELECT min(kind) FROM k)""")
def priority_concept_lookup(spark, d):
    n = table(spark, d, "supplier").select(F.col("s_name").alias("name")).unionByName(table(spark, d, "customer").select(F.col("c_name").alias("name")))
    return search.find_concept(n, "00000012")


_NS = (("w", "http://"), ("s", "https://"), ("b", "https://blog."), ("b2", "http://blog."), ("m", "https://m."), ("www", "http://www."), ("sw", "https://www."))


@query("WITH n(prefix, base) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _NS) + """), r AS (SELECT url, prefix, base, row_number() OVER (PARTITION BY url ORDER BY length(base) DESC, prefix) AS k FROM (SELECT DISTINCT url FROM pages) LEFT JOIN n ON starts_with(url, base) AND length(url) > length(base))
SELECT url AS term, prefix, prefix || ':' || substr(url, length(base) + 1) AS qname FROM r WHERE k = 1""")
def longest_prefix_namespace(spark, d):
    ns = spark.createDataFrame(_NS, "prefix string, base string")
    got = catalog.longest_prefix(table(spark, d, "pages").select(F.col("url").alias("term")).distinct(), ns)
    return got.select("term", "prefix", F.concat("prefix", F.lit(":"), F.expr("substring(term, length(base) + 1)")).alias("qname"))


@query("""SELECT page_id, regexp_extract(url, '([^#/:]*)$', 1) AS tail, CASE WHEN regexp_extract(url, '([^#/:]*)$', 1) = '' THEN url ELSE regexp_extract(url, '([^#/:]*)$', 1) END AS local_name,
 CASE WHEN contains(url, '#') THEN regexp_extract(url, '^(.*#)', 1) WHEN contains(url, '/') THEN regexp_extract(url, '^(.*/)', 1) ELSE url END AS namespace FROM pages""")
def iri_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(u, r"([^#/:]*)$", 1).alias("tail"), names.local_name(u).alias("local_name"), names.namespace_of(u).alias("namespace"))


# The address forms that name an organisation and a source.
_P = names.ADDRESS_FORMS


@query(f"""WITH u AS (SELECT page_id, regexp_replace(url, '[#/]+$', '') AS u FROM pages), p AS (SELECT *, list_filter(string_split(u, '/'), lambda x: x <> '' AND NOT contains(x, ':') AND NOT contains(x, '.')) AS l FROM u)
SELECT page_id, CASE WHEN regexp_matches(u, '{_P[0]}') THEN regexp_extract(u, '{_P[0]}', 1) WHEN regexp_matches(u, '{_P[1]}') THEN regexp_extract(u, '{_P[1]}', 1) WHEN regexp_matches(u, '{_P[2]}') THEN regexp_extract(u, '{_P[2]}', 1) WHEN len(l) >= 2 THEN l[-2] END AS org,
CASE WHEN regexp_matches(u, '{_P[0]}') THEN regexp_extract(u, '{_P[0]}', 2) WHEN regexp_matches(u, '{_P[1]}') THEN regexp_extract(u, '{_P[1]}', 2) WHEN regexp_matches(u, '{_P[2]}') THEN regexp_extract(u, '{_P[2]}', 2) WHEN len(l) >= 1 THEN l[-1] END AS source,
CASE WHEN regexp_matches(u, '{_P[0]}') OR regexp_matches(u, '{_P[1]}') THEN 'high' WHEN regexp_matches(u, '{_P[2]}') THEN 'medium' WHEN len(l) >= 1 THEN 'low' ELSE 'none' END AS confidence FROM p""")
def infer_org_source(spark, d):
    org, source, how = names.org_and_source(F.col("url"))
    return table(spark, d, "pages").select("page_id", org.alias("org"), source.alias("source"), how.alias("confidence"))


_CAMEL = "p_partkey, regexp_replace(p_name || 'Of' || p_type, ' ', '', 'g') AS n FROM part"


@query(f"""SELECT p_partkey, upper(regexp_replace(n, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS relationship, lower(regexp_replace(n, '([a-z0-9])([A-Z])', '\\1-\\2', 'g')) AS kebab,
 regexp_replace(n, '[^A-Za-z0-9_]', '_', 'g') AS identifier, n || 'Type' AS edge_class FROM (SELECT {_CAMEL})""")
def identifier_casing(spark, d):
    n = F.replace(F.concat("p_name", F.lit("Of"), "p_type"), F.lit(" "), F.lit(""))
    rows = table(spark, d, "part").select("p_partkey", n.alias("n"))
    n = F.col("n")
    return rows.select("p_partkey", names.relationship_type(n).alias("relationship"), names.kebab(n).alias("kebab"), names.graph_identifier(n).alias("identifier"), names.edge_class_name(n).alias("edge_class"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents")
def definition_fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", values.definition_hash(F.col("text")).alias("hash"))


def _versions(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("key"), values.definition_hash(F.col("text")).alias("hash"), F.lit(0).alias("pos"), "text")
    changed = t.where("key % 11 <> 0").withColumn("hash", F.when(F.col("key") % 7 == 0, values.definition_hash(F.concat(F.coalesce("text", F.lit("")), F.lit("!")))).otherwise(F.col("hash")))
    return t.drop("text"), changed.drop("text").unionByName(t.where("key % 13 = 0").select((F.col("key") + 10_000_000).alias("key"), "hash", "pos"))


_STALE = """WITH o AS (SELECT doc_id AS key, substr(sha256(text), 1, 16) AS h FROM documents), n AS (SELECT doc_id AS key, CASE WHEN doc_id % 7 = 0 THEN substr(sha256(coalesce(text, '') || '!'), 1, 16) ELSE substr(sha256(text), 1, 16) END AS h FROM documents WHERE doc_id % 11 <> 0 UNION ALL SELECT doc_id + 10000000, substr(sha256(text), 1, 16) FROM documents WHERE doc_id % 13 = 0),
x AS (SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'new' WHEN n.key IS NULL THEN 'dropped' WHEN o.h IS NOT NULL AND n.h IS NOT NULL AND o.h <> n.h THEN 'stale' ELSE 'current' END AS status FROM o FULL JOIN n ON o.key = n.key)"""


@query(_STALE + " SELECT key, status FROM x")
def staleness_diff(spark, d):
    return similarity.staleness(*_versions(spark, d))


@query(_STALE + " SELECT status, count(*) AS n FROM x GROUP BY status")
def stale_summary(spark, d):
    return staleness_diff(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT lang, count(*) AS total, count(*) FILTER (NOT coalesce(length(trim(text)) > 0, false)) AS missing, round(100.0 * count(*) FILTER (coalesce(length(trim(text)) > 0, false)) / greatest(count(*), 1), 1) AS coverage,
 round(avg(CASE WHEN length(trim(text)) > 0 THEN length(text) END))::BIGINT AS mean_length FROM documents GROUP BY lang""")
def definition_quality(spark, d):
    return catalog.definition_quality(table(spark, d, "documents").select("lang", F.col("text").alias("definition")), ["lang"])


@query("SELECT doc_id, lang, length(text) AS n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY length(text), doc_id) AS k FROM documents WHERE length(trim(text)) > 0) WHERE k <= 5")
def shortest_definitions(spark, d):
    docs = table(spark, d, "documents").where(F.length(F.trim("text")) > 0).select("doc_id", "lang", F.length("text").cast("long").alias("n"))
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("lang").orderBy("n", "doc_id"))
    return docs.withColumn("k", k).where("k <= 5").drop("k")


@query("SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def duplicate_definitions(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select(F.md5("text").alias("definition"), F.col("doc_id").alias("pos"))
    return catalog.duplicate_definitions(rows).withColumnRenamed("definition", "digest")


_WHOLE = "w AS (SELECT DISTINCT c_mktsegment AS vocab, n_name, o_orderpriority AS p, o_orderstatus AS s, month(o_orderdate) AS m FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey)"
_MEMBERS = "SELECT DISTINCT vocab, n_name || '/' || p || '/' || s AS member FROM w"


def _segments(spark, d):
    """What the customers of each market segment have ordered: nations, priorities, statuses and months."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return c.select(F.col("c_mktsegment").alias("vocab"), "n_name", F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), F.month("o_orderdate").alias("m")).distinct()


def _members(w):
    return w.select("vocab", F.concat_ws("/", "n_name", "p", "s").alias("member"))


@query(f"""WITH {_WHOLE}, m AS ({_MEMBERS}), z AS (SELECT vocab, count(*) AS n FROM m GROUP BY vocab), b AS (SELECT l.vocab AS a, r.vocab AS b, count(*) AS shared FROM m l JOIN m r ON l.member = r.member AND l.vocab < r.vocab GROUP BY ALL)
SELECT x.vocab AS a, y.vocab AS b, coalesce(shared, 0) AS shared, x.n - coalesce(shared, 0) AS only_a, y.n - coalesce(shared, 0) AS only_b, coalesce(shared, 0)::DOUBLE / (x.n + y.n - coalesce(shared, 0)) AS jaccard FROM z x JOIN z y ON x.vocab < y.vocab LEFT JOIN b ON b.a = x.vocab AND b.b = y.vocab""")
def jaccard_pairs(spark, d):
    return similarity.pairs(_members(_segments(spark, d)))


_PAIRED = """SELECT l.vocab AS a, r.vocab AS b, coalesce(s.n, 0)::DOUBLE / (l.n + r.n - coalesce(s.n, 0)) AS j FROM (SELECT vocab, count(*) AS n FROM {m} GROUP BY vocab) l JOIN (SELECT vocab, count(*) AS n FROM {m} GROUP BY vocab) r ON l.vocab < r.vocab
 LEFT JOIN (SELECT x.vocab AS a, y.vocab AS b, count(*) AS n FROM {m} x JOIN {m} y ON x.member = y.member AND x.vocab < y.vocab GROUP BY ALL) s ON s.a = l.vocab AND s.b = r.vocab"""


@query(f"""WITH {_WHOLE}, mt AS ({_MEMBERS}), mn AS (SELECT DISTINCT vocab, n_name AS member FROM w), mc AS (SELECT DISTINCT vocab, s || p AS member FROM w),
mp AS (SELECT DISTINCT vocab, n_name AS key, s || p || m AS member FROM w),
k AS (SELECT vocab, key, count(*) AS n FROM mp GROUP BY ALL), x AS (SELECT l.vocab AS a, r.vocab AS b, key, count(*) AS s FROM mp l JOIN mp r USING (key, member) WHERE l.vocab < r.vocab GROUP BY ALL),
e AS (SELECT l.vocab AS a, r.vocab AS b, l.n AS na, r.n AS nb, coalesce(s, 0) AS s FROM k l JOIN k r ON l.key = r.key AND l.vocab < r.vocab LEFT JOIN x ON x.a = l.vocab AND x.b = r.vocab AND x.key = l.key),
pt AS ({_PAIRED.format(m="mt")}), pn AS ({_PAIRED.format(m="mn")}), pc AS ({_PAIRED.format(m="mc")}), pp AS (SELECT a, b, round(avg(s::DOUBLE / (na + nb - s)), 4) AS j FROM e GROUP BY ALL)
SELECT a, b, round(0.4 * coalesce(pt.j, 0) + 0.3 * coalesce(pp.j, 0) + 0.1 * coalesce(pn.j, 0) + 0.2 * round(coalesce(pc.j, 0), 4), 4) AS composite FROM pt FULL JOIN pp USING (a, b) FULL JOIN pn USING (a, b) FULL JOIN pc USING (a, b)""")
def overlap_composite(spark, d):
    w = _segments(spark, d)
    scored = lambda df: similarity.pairs(df).select("a", "b", F.col("jaccard").alias("score"))
    props = w.select("vocab", F.col("n_name").alias("key"), F.concat("s", "p", F.col("m").cast("string")).alias("member"))
    per_type = similarity.keyed_overlap(props).select("a", "b", F.col("average_jaccard").alias("score"))
    return similarity.composite({"type": scored(_members(w)), "property": per_type, "namespace": scored(w.select("vocab", F.col("n_name").alias("member"))), "codelist": similarity.scheme_overlap(w.select("vocab", F.concat("s", "p").alias("key"))).select("a", "b", F.col("scheme_jaccard").alias("score"))})


@query(f"""WITH {_WHOLE}, mp AS (SELECT DISTINCT vocab, n_name AS key, s || p || m AS member FROM w), k AS (SELECT vocab, key, count(*) AS n FROM mp GROUP BY ALL),
x AS (SELECT l.vocab AS a, r.vocab AS b, key, count(*) AS s FROM mp l JOIN mp r USING (key, member) WHERE l.vocab < r.vocab GROUP BY ALL)
SELECT l.vocab AS a, r.vocab AS b, l.key, round(coalesce(s, 0)::DOUBLE / (l.n + r.n - coalesce(s, 0)), 4) AS value_jaccard, coalesce(s, 0) AS shared_values, l.n AS a_values, r.n AS b_values
FROM k l JOIN k r ON l.key = r.key AND l.vocab < r.vocab LEFT JOIN x ON x.a = l.vocab AND x.b = r.vocab AND x.key = l.key""")
def codelist_value_overlap(spark, d):
    return similarity.value_overlap(_segments(spark, d).select("vocab", F.col("n_name").alias("key"), F.concat("s", "p", F.col("m").cast("string")).alias("member")))


@query("""WITH o AS (SELECT url AS path, md5(html) AS d FROM pages WHERE page_id % 9 <> 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1), n AS (SELECT url AS path, md5(html || CASE WHEN page_id % 5 = 0 THEN '!' ELSE '' END) AS d FROM pages WHERE page_id % 8 <> 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1)
SELECT path, status FROM (SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'removed' WHEN o.path IS NULL THEN 'added' WHEN o.d <> n.d THEN 'changed' END AS status FROM o FULL JOIN n ON o.path = n.path) WHERE status IS NOT NULL""")
def digest_map_diff(spark, d):
    p = table(spark, d, "pages")
    a = p.where("page_id % 9 <> 0").select(F.col("url").alias("path"), "page_id", F.md5("html").alias("digest"))
    b = p.where("page_id % 8 <> 0").select(F.col("url").alias("path"), "page_id", F.md5(F.concat("html", F.when(F.col("page_id") % 5 == 0, "!").otherwise(""))).alias("digest"))
    return similarity.digest_diff(catalog.first_by(a, ["path"], "page_id"), catalog.first_by(b, ["path"], "page_id"))


@query("SELECT doc_id, lang, place FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS place FROM documents) WHERE place <= 20")
def stratified_sample(spark, d):
    return search.stratified(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 20)
