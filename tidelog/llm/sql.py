"""The same results in SQL, for the queries that SQL can express on whole tables."""

from tidelog.llm import quality

_SEPARATORS = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(regexp_split_to_array({{text}}, '{_SEPARATORS}'), lambda x: x <> '')"


def _words(text: str) -> str:
    return _WORDS.replace("{text}", text)


def _fails(rule: quality.Rule) -> str:
    unit = f"CAST({rule.per} AS DOUBLE)" if rule.per else "CAST(1 AS DOUBLE)"
    checks = []
    if rule.low is not None:
        checks.append(f"{rule.measure} * 100 < {unit} * {rule.low * 100!r}")
    if rule.high is not None:
        checks.append(f"{rule.measure} * 100 > {unit} * {rule.high * 100!r}")
    return f"(n_words >= {rule.min_words} AND ({' OR '.join(checks)}))"


def quality_sql() -> str:
    rules = (*quality.BASE_RULES, *quality.METHOD_RULES)
    stop_words = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
    names = ", ".join(f"CASE WHEN {_fails(r)} THEN '{r.name}' END" for r in rules)
    symbols = quality.SYMBOLS
    width = quality.WINDOW
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT doc_id, t, {_words('t')} AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM texts),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + {width - 1}], ' ') AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {width - 2})) AS i FROM split)),
repeated AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, sum(least({width}, coalesce(later - i, {width}))) AS n
  FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS later FROM repeated) GROUP BY doc_id),
measured AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^{symbols}]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(words, lambda x: x IN ({stop_words}))) AS BIGINT) AS n_stop_words
  FROM split LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, {' OR '.join(_fails(r) for r in quality.BASE_RULES)} AS base_failed,
    concat_ws(',', {names}) AS failed_rules FROM measured)
SELECT *, failed_rules = '' AS kept FROM judged"""


def _apportioned(name: str, claims: str, group: str, item: str, claim: str, seats: str) -> str:
    """CTEs that add quota to the claims: seats of each item by highest quotients."""
    over = f"OVER (PARTITION BY {group})"
    return f"""{name}_1 AS (SELECT *, count(*) {over} AS _n, CAST(sum({claim}) {over} AS DOUBLE) AS _total FROM {claims}),
{name}_2 AS (SELECT *,
    CASE WHEN _total > 0 THEN {claim} * {seats} / _total ELSE 0 END AS _exact,
    CASE WHEN {seats} > 0 THEN _n / ({seats} * 2.0) ELSE 0 END AS _spread FROM {name}_1),
{name}_3 AS (SELECT *, CAST(greatest(0, floor(_exact * (1 - _spread) - 1.5)) AS BIGINT) AS _sure,
    CAST(ceil(_exact * (1 + 2 * _spread) + 1.5) AS BIGINT) AS _most FROM {name}_2),
{name}_4 AS (SELECT *, {seats} - sum(_sure) {over} AS _open FROM {name}_3),
{name}_5 AS (SELECT *, CAST({claim} AS DOUBLE) / (_seat * 2 - 1) AS _quotient
  FROM (SELECT *, unnest(range(_sure + 1, _most + 1)) AS _seat FROM {name}_4 WHERE {claim} > 0)),
{name}_6 AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY _quotient DESC, {item} NULLS LAST) AS _rank FROM {name}_5),
{name}_7 AS (SELECT {group} AS _group, {item} AS _item, count(*) AS _won FROM {name}_6 WHERE _rank <= _open GROUP BY ALL),
{name} AS (SELECT a.*, CASE WHEN {claim} > 0 THEN _sure + coalesce(_won, 0) ELSE 0 END AS quota
  FROM {name}_4 a LEFT JOIN {name}_7 b ON a.{group} IS NOT DISTINCT FROM b._group AND a.{item} IS NOT DISTINCT FROM b._item)"""


def mixing_sql(n_blocks: int = 131072, n_shards: int = 64, seed: int = 11, most: int = 3) -> str:
    prime = 2**31 - 1

    def mod(x: str) -> str:
        return f"((({x}) % {prime} + {prime}) % {prime})"

    first = mod("coalesce(doc_id, 0) * 31 + size")
    second = f"(({first} * 48271 + {seed + 1}) % {prime})"
    number = f"(({second} * 69621 + {seed + 7}) % {prime})"
    return f"""WITH sized AS (SELECT doc_id, source, CAST(len({_words("coalesce(text, '')")}) AS BIGINT) AS size FROM documents),
docs AS (SELECT *, CAST({number} AS BIGINT) AS place, CAST({number} % {n_shards} AS INTEGER) AS shard FROM sized),
shards AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS shard_size FROM docs GROUP BY ALL),
sources AS (SELECT source, CAST(sum(shard_size) AS BIGINT) AS source_size, 1 AS one FROM shards GROUP BY source),
weighted AS (SELECT *, source_size * {most} AS capacity,
    [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sources),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(capacity) OVER earlier, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level FROM weighted
  WINDOW earlier AS (ORDER BY capacity / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
shared AS (SELECT *, max(level) OVER () * weight AS share, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM levels),
targets AS (SELECT source, source_size, one, CASE WHEN share > capacity THEN CAST(capacity AS DOUBLE) ELSE share END AS target,
    CAST(greatest(1, ceil(total / {n_blocks})) AS BIGINT) AS block, total FROM shared),
blocks AS (SELECT *, total // block AS blocks FROM targets),
{_apportioned('by_source', 'blocks', 'one', 'source', 'target', 'blocks')},
claims AS (SELECT h.source, h.shard, shard_size, source_size, target, block, quota AS source_quota
  FROM shards h JOIN by_source s ON h.source IS NOT DISTINCT FROM s.source),
{_apportioned('by_shard', 'claims', 'source', 'shard', 'shard_size', 'source_quota')},
plans AS (SELECT *, least(quota * block, shard_size * {most}) AS words,
    (shard * 7919 + {seed * 104729}) % greatest(shard_size, 1) // block * block AS run_start FROM by_shard),
runs AS (SELECT *, CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END AS passes,
    CASE WHEN shard_size > 0 THEN words % shard_size ELSE 0 END AS run FROM plans),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY place, doc_id NULLS LAST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM docs),
cut AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.passes,
    greatest(0, least(begins + size, run_start + run, shard_size) - greatest(begins, run_start))
    + greatest(0, least(begins + size, run_start + run - shard_size) - begins) AS once_more
  FROM placed d JOIN runs r ON d.source IS NOT DISTINCT FROM r.source AND d.shard = r.shard)
SELECT doc_id, size, source_size, target, CAST(passes * size + once_more AS BIGINT) AS taken,
  CAST(passes AS BIGINT) AS passes FROM cut"""


def join_sql(width: int = 3, top: int = 90, bottom: int = 100) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = f"translate(coalesce(text, ''), '{upper}', '{upper.lower()}')"
    return f"""WITH RECURSIVE split AS (SELECT doc_id, {_words(lower)} AS words FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {width}
    THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - {width - 2}), lambda i: array_to_string(words[i:i + {width - 1}], ' ')) END)) AS grams FROM split),
classes AS (SELECT min(doc_id) AS class_id, grams, CAST(len(grams) AS BIGINT) AS n FROM sets WHERE len(grams) > 0 GROUP BY grams),
tokens AS (SELECT class_id, n, unnest(grams) AS gram FROM classes),
pairs AS (SELECT a.class_id AS a, b.class_id AS b FROM tokens a JOIN tokens b ON a.gram = b.gram AND a.class_id <> b.class_id
  GROUP BY a.class_id, b.class_id HAVING {bottom} * count(*) >= {top} * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT class_id AS a, class_id AS b FROM classes UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
named AS (SELECT a AS class_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, coalesce(c.class_id, s.doc_id) AS class_id,
  coalesce(m.component_id, s.doc_id) AS component_id
FROM sets s LEFT JOIN classes c ON s.grams = c.grams LEFT JOIN named m ON c.class_id = m.class_id"""


def middle_sql(seed: int = 1, rate: int = 90, spm: int = 20) -> str:
    def group(number: int) -> str:
        return f"CAST('0x' || substr(h, {1 + 8 * number}, 8) AS BIGINT)"

    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
    sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
cut AS (SELECT doc_id, t, CAST(n AS BIGINT) AS n, least({group(0)} % (n + 1), {group(1)} % (n + 1)) AS a,
    greatest({group(0)} % (n + 1), {group(1)} % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {group(2)} % 100 >= {rate} THEN 'plain'
      WHEN {group(3)} % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM texts),
pieces AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s FROM cut)
SELECT doc_id, n, form, CAST(CASE WHEN form <> 'plain' THEN a END AS BIGINT) AS prefix_chars,
  CAST(CASE WHEN form <> 'plain' THEN b - a END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM pieces"""


def negatives_sql(scale: int = 256) -> str:
    return f"""WITH vectors AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""
