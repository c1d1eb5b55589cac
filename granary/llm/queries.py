"""The operators as queries over the test tables: opN_<name>(spark, sf_dir), and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import byte_cnn, chat, collocations, dominance_packing, exact_dedup, line_dedup, mixing, packing, quality_rules, resampling, simhash, token_output, toxicity
from granary.llm.common import shared_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, code=simhash.TIGHT)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.grade(docs, model, F.col("doc_id"))
    return out.select(F.col("row").alias("doc_id"), "severity", "grade", (F.col("grade") > 0).cast("int").alias("toxic"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = token_output.token_matrix(table(spark, sf_dir, "documents"))
    return token_output.segments(token_output.write_matrix(matrix, shared_table(spark)))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


#: The tree of op7: a source's domain follows from its number; values that are not named have weight 1.
DOMAINS = ("web", "books", "forum")
MIX_WEIGHTS = {"domain": {"web": 5, "books": 3, "forum": 2}, "lang": {"en": 6, "de": 2}, "source": {"src0": 2}}
MIX_SHARE, MIX_EPOCHS = 0.8, 3


def mix_levels() -> dict:
    number = F.expr("coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as int), 0)") % 3
    return {"domain": F.element_at(F.array(*map(F.lit, DOMAINS)), number + 1), "lang": F.col("lang"), "source": F.col("source")}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), mix_levels(), MIX_WEIGHTS, budget_share=MIX_SHARE, max_epochs=MIX_EPOCHS)
    return out.select("row.doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), quality_rules.trusted_ids(table(spark, sf_dir, "labels")))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = byte_cnn.fit(docs, table(spark, sf_dir, "labels"))
    out = byte_cnn.score(docs, net, F.col("doc_id").alias("row"))
    return out.select(F.col("row").alias("doc_id"), byte_cnn.held_out("row").alias("held_out"), "score", (F.col("score") >= byte_cnn.THRESHOLD).cast("int").alias("predicted"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds, more = dict(rows.dtypes), spark.range(0, 2, 1, 1)
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = more.select(F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    out = chat.read_back(chat.windows(rows.unionByName(more)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = out.select("conv_id", F.struct("window", F.size("turns").cast("long").alias("turns"), said.alias("said"), "loss_text", "formatted_chars").alias("w"))
    parts = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))  # a digest is over one whole conversation

    def total(name: str) -> F.Column:
        return F.aggregate("w", F.lit(0).cast("long"), lambda acc, w: acc + w[name])

    parts = parts.select("conv_id", total("turns").alias("n_turns"), F.array_join(F.transform("w", lambda w: w["said"]), "").alias("said"), F.array_join(F.transform("w", lambda w: w["loss_text"]), "").alias("loss"), total("formatted_chars").alias("formatted_chars"))
    return parts.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_fewest_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance_packing.pack_fewest(table(spark, sf_dir, "documents"), with_ids=False)


_ALL = (op1_simhash, op2_packing, op3_toxicity, op4_line_dedup, op5_token_output, op6_exact_dedup, op7_mixing, op8_quality_rules, op9_quality_classifier, op10_chat, op11_resampling, op12_collocations, op13_fewest_sequences)
QUERIES = {f.__name__: f for f in _ALL}


def _mixing_sql() -> str:
    """op7: the budgets flow down level by level in window sums over (most / w, name); see mixing.budgets."""
    weight = {level: "CASE " + " ".join(f"WHEN {level} = '{v}' THEN {float(w)}" for v, w in names.items()) + " ELSE 1.0 END::DOUBLE" for level, names in MIX_WEIGHTS.items()}
    steps, path = [], []
    for k, level in enumerate(MIX_WEIGHTS):
        parent, path = ", ".join(path), [*path, level]
        within = f"PARTITION BY {parent}" if parent else ""
        flow = f"(SELECT CAST({MIX_SHARE} AS DOUBLE) * sum(n)::DOUBLE FROM leaf)" if not k else f"(SELECT share FROM g{k - 1} g WHERE " + " AND ".join(f"g.{c} = m.{c}" for c in path[:-1]) + ")"
        steps.append(f"""
m{k} AS (SELECT {", ".join(path)}, CAST(sum(n) * {MIX_EPOCHS} AS DOUBLE) AS most, {weight[level]} AS w FROM leaf GROUP BY {", ".join(path)}
), n{k} AS (SELECT *, {flow} AS flow FROM m{k} m
), f{k} AS (SELECT *, most * sum(w) OVER ({within} ORDER BY most / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= (flow - (sum(most) OVER ({within} ORDER BY most / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - most)) * w AS filled FROM n{k}
), g{k} AS (SELECT {", ".join(path)}, CASE WHEN filled THEN most ELSE
  (flow - sum(CASE WHEN filled THEN most ELSE 0 END) OVER ({within})) * w / sum(CASE WHEN filled THEN 0 ELSE w END) OVER ({within}) END AS share FROM f{k}
), """)
    domains = ", ".join(f"'{d}'" for d in DOMAINS)
    return f"""
WITH docs AS (
  SELECT doc_id, md5(coalesce(text, '')) AS h, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n,
         list_extract([{domains}], coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT), 0) % 3 + 1) AS domain FROM documents
), leaf AS (SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS n FROM docs GROUP BY ALL
), {"".join(steps)}
plan AS (SELECT l.*, CAST(floor(share) AS BIGINT) AS budget, CASE WHEN n > 0 THEN CAST(floor(share) AS BIGINT) // n ELSE 0 END AS epochs FROM leaf l JOIN g2 USING (domain, lang, source)
), keyed AS (SELECT d.*, p.epochs, p.budget - p.epochs * p.n AS part, CAST('0x' || md5('{mixing.SEED}|' || p.epochs || '|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || h)[1:15] AS BIGINT) AS k FROM docs d JOIN plan p USING (domain, lang, source)
), taken AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY k) <= part AS more FROM keyed)
SELECT doc_id, domain, lang, source, n AS n_tokens, CAST(unnest(range(0, CAST(epochs + CASE WHEN more THEN 1 ELSE 0 END AS BIGINT))) AS INT) AS epoch FROM taken"""


def _chat_sql() -> str:
    """op10: the windows open in a recursion over the turns; see chat.windows."""
    bs = "chr(92)"
    room = f"CASE WHEN g.win = 0 THEN {chat.BUDGET} ELSE greatest(1, {chat.BUDGET - chat.HISTORY} - c.systok) END"
    opens = f"p.i % {chat.BLOCK} = 0 OR p.pre + p.tok - g.base > {room}"
    control = r"(<|\[)(\||/?s>|/?INST\]|<SYS>>|</SYS>>|</SYS>|<SYS>)"
    body = f"regexp_replace(replace(text, {bs}, {bs} || {bs}), '{control}', '\\1' || {bs} || {bs} || '\\2', 'g')"
    head = f"replace(regexp_replace(replace(role, {bs}, {bs} || {bs}), '{control}', '\\1' || {bs} || {bs} || '\\2', 'g'), chr(10), {bs} || chr(10))"
    return f"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i,
         len(regexp_extract_all(text, '{chat.PIECE}')) + {chat.TURN_TOKENS} AS tok,
         {len(chat.START) + len(chat.END) + 1} + length({head}) + length({body}) AS chars FROM src
), p AS (
  SELECT *, coalesce(sum(tok) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre FROM t
), c AS (
  SELECT conv_id, count(*) AS n, max(CASE WHEN i = 0 AND role = 'system' THEN 1 ELSE 0 END) AS sys, max(CASE WHEN i = 0 AND role = 'system' THEN tok ELSE 0 END) AS systok,
         max(CASE WHEN i = 0 AND role = 'system' THEN chars ELSE 0 END) AS syschars FROM p GROUP BY 1
), go AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS win, CAST(0 AS BIGINT) AS base FROM c
  UNION ALL
  SELECT g.conv_id, p.i,
         CASE WHEN {opens} THEN g.win + 1 ELSE g.win END, CAST(CASE WHEN {opens} THEN p.pre ELSE g.base END AS BIGINT)
  FROM go g JOIN p ON p.conv_id = g.conv_id AND p.i = g.i + 1 JOIN c ON c.conv_id = g.conv_id
), w AS (
  SELECT conv_id, win, min(base) AS base FROM go GROUP BY ALL
), extra AS (
  SELECT w.conv_id, sum(CASE WHEN p.i >= c.sys AND p.pre < w.base AND w.base - p.pre <= {chat.HISTORY} THEN p.chars ELSE 0 END)
         + sum(CASE WHEN p.i = 0 THEN c.syschars ELSE 0 END) AS chars
  FROM w JOIN p USING (conv_id) JOIN c USING (conv_id) WHERE w.win > 0 GROUP BY 1
)
SELECT p.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(p.chars) + coalesce(any_value(e.chars), 0) AS BIGINT) AS formatted_chars
FROM p LEFT JOIN extra e USING (conv_id) GROUP BY 1"""


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = {
    "op4_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), each AS (
  SELECT doc_id, r, ls, unnest(range(1, len(ls) + 1)) AS i FROM lines
), keyed AS (
  SELECT doc_id, r, i, ls[i] AS line, translate(trim(ls[i], {_SPACE}), '{_UPPER}', '{_LOWER}') AS k FROM each
), often AS (
  SELECT k, max(doc_id) AS stays FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT r) >= 5
), marked AS (
  SELECT keyed.*, o.k IS NOT NULL AND o.stays <> keyed.doc_id AS gone FROM keyed LEFT JOIN often o USING (k)
)
SELECT max(doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r""",
    "op6_exact_dedup": f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS k FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY k) AS keep_id, count(*) OVER (PARTITION BY k) AS group_size,
       row_number() OVER (PARTITION BY k ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(k) AS text_sha256
FROM t""",
    "op7_mixing": _mixing_sql(),
    "op10_chat": _chat_sql(),
    "op11_resampling": f"""
WITH tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bench AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), df AS (
  SELECT r, unnest(w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM docs
), bf AS (
  SELECT unnest(w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM bench
), hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(f)) + 1), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i - 1, 2) AS BIGINT))),
         lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS b
  FROM (SELECT f FROM df UNION SELECT f FROM bf), tab
), s AS (SELECT b, count(*) AS s FROM df JOIN hashed USING (f) GROUP BY 1
), t AS (SELECT b, count(*) AS t FROM bf JOIN hashed USING (f) GROUP BY 1
), gain AS (
  SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bf) + 10000)::DOUBLE))) AS BIGINT) AS g
  FROM s FULL JOIN t USING (b)
), sums AS (SELECT r, count(*) AS n, sum(g) AS g FROM df JOIN hashed USING (f) JOIN gain USING (b) GROUP BY 1
), scored AS (
  SELECT doc_id, len(w) >= 20 AS may, coalesce(n, 0) AS n_features, coalesce(CAST(floor(g / n) AS BIGINT), 0) AS weight,
         CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise
  FROM docs LEFT JOIN sums USING (r)
), placed AS (
  SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY may ORDER BY weight + noise DESC, doc_id) AS place, sum(CASE WHEN may THEN 1 ELSE 0 END) OVER () AS eligible FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= 25 * eligible // 100 THEN place END AS rank FROM placed""",
    "op12_collocations": f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  {" UNION ALL ".join(f"SELECT lang, {k} AS m, unnest(list_transform(range(1, greatest(len(w) - {k - 2}, 1)), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS phrase FROM w" for k in range(1, 6))}
), f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100
), totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1
), c AS MATERIALIZED (SELECT * FROM f WHERE m > 1
), cuts AS MATERIALIZED (SELECT c.*, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM c
), cut AS MATERIALIZED (
  SELECT x.lang, x.phrase, x.f AS a, x.k, l.f AS l, r.f AS r, n, 1000::HUGEINT * x.f * n // (l.f::HUGEINT * r.f) AS score
  FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(ws[1:k], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(ws[k + 1:], ' ') JOIN totals t ON t.lang = x.lang
), weakest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
  SELECT * FROM weakest x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = x.lang AND c.f = x.a AND c.phrase <> x.phrase AND contains(' ' || c.phrase || ' ', ' ' || x.phrase || ' '))
), placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM placed WHERE rank <= 2000""",
}
