"""SQL that states the results of those dealt operators that SQL can express on whole tables."""

from __future__ import annotations

from bladewatch.llm import collocations, lexical_search, line_dedup, mixing, weak_rules

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def mixing_sql() -> str:
    weights = "[" + ", ".join(map(str, mixing.WEIGHTS)) + "]"
    return rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS symbols FROM documents),
k AS (SELECT doc_id, source, size, -ln((CAST('0x' || substr(md5('{mixing.SEED}:' || CAST(doc_id AS VARCHAR)), 1, 12) AS
    BIGINT) + 0.5e0) / {float(1 << 48)!r}) / greatest({mixing.LEAST_QUALITY}e0, 1e0 - symbols / CAST(greatest(size, 1) AS
    DOUBLE)) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, {mixing.MAX_EPOCHS} * source_size AS cap,
    {weights}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight FROM s),
r AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS DOUBLE)
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS DOUBLE) AS rate FROM w
    WINDOW o AS (ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN cap <= rate * weight THEN CAST(cap AS DOUBLE) ELSE
    weight * max(rate) FILTER (WHERE cap > rate * weight) OVER () END AS target FROM r),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), {mixing.MAX_EPOCHS}) AS BIGINT)
    ELSE 0 END AS epochs FROM t),
b AS (SELECT *, CAST(floor(target + 0.5e0) AS BIGINT) - epochs * source_size AS rest FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - (
    sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size))) AS BIGINT) AS taken
FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source"""


def _measures_sql() -> str:
    stop = ", ".join(f"'{f(w)}'" for w in weak_rules.STOP_WORDS for f in (str.lower, str.capitalize))
    return rf"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w, array_to_string({_WORDS}, '') AS joined,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
x AS (SELECT row, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (
    SELECT row, w, unnest(generate_series(1, CAST(len(w) AS BIGINT) - 2)) AS i FROM t)),
y AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, a, b, c) AS n FROM x) WHERE n > 1),
z AS (SELECT row, count(DISTINCT i + o) AS n FROM y, (VALUES (0), (1), (2)) v(o) GROUP BY row),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(joined) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(joined, '[^{weak_rules.SYMBOLS}]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(z.n, 0) AS BIGINT) AS n_repeat_words,
    len(l) AS n_lines, len(list_intersect(w, [{stop}])) AS n_stop_kinds,
    length(regexp_replace(joined, '[^{weak_rules.MARKS}]+', '', 'g')) AS n_marks,
    length(regexp_replace(joined, '[^.!?]+', '', 'g')) AS n_ends FROM t LEFT JOIN z USING (row))"""


# rule: (votes bad if, votes good if), as ``weak_rules.votes``
_VOTES = {
    "length": ("n_words < 20", "n_words >= 80"),
    "word_length": ("word_chars < 2 * n_words OR word_chars > 8 * n_words",
                    "word_chars >= 3 * n_words AND 2 * word_chars <= 13 * n_words"),
    "symbols": ("20 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    "lines": ("n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 AND n_lines >= 2"),
    "repeats": ("10 * n_repeat_words > 3 * n_words", "10 * n_repeat_words <= n_words"),
    "stop_words": ("n_words >= 30 AND n_stop_kinds = 0", "n_stop_kinds >= 2"),
    "letters": ("8 * n_marks > word_chars", "10 * n_marks <= word_chars"),
    "sentences": ("n_words >= 50 AND 50 * n_ends < n_words", "40 * n_ends >= n_words AND 2 * n_ends <= n_words"),
}


def quality_sql() -> str:
    rules, low, high = list(_VOTES), *weak_rules.ACCURACY_BOUNDS
    votes = ", ".join(f"CASE WHEN {b} THEN -1 WHEN {g} THEN 1 ELSE 0 END AS v_{r}" for r, (b, g) in _VOTES.items())
    names = ", ".join(f"v_{r}" for r in rules)
    odds = "ln(prior / (1e0 - prior))" + "".join(
        f" + CASE v_{r} WHEN 1 THEN ln(g_{r} / (1e0 - b_{r})) WHEN -1 THEN ln((1e0 - g_{r}) / b_{r}) ELSE 0e0 END" for r in rules)
    start = weak_rules.START_ACCURACY
    out = _measures_sql() + f""",
q AS (SELECT *, {votes} FROM m), pat AS (SELECT {names}, count(*) AS n FROM q GROUP BY ALL),
e0 AS (SELECT {weak_rules.START_PRIOR}e0 AS prior, {', '.join(f'{start}e0 AS g_{r}, {start}e0 AS b_{r}' for r in rules)})"""
    for k in range(1, weak_rules.ROUNDS + 1):
        def accuracy(r, share, right):
            cast = f"sum(n * {share}) FILTER (WHERE v_{r} = {right})"
            every = f"sum(n * {share}) FILTER (WHERE v_{r} <> 0)"
            return f"least(greatest((coalesce({cast}, 0e0) + {start}e0) / (coalesce({every}, 0e0) + 1e0), {low}e0), {high}e0)"

        out += f""",
e{k} AS MATERIALIZED (SELECT least(greatest(sum(n * p) / sum(n), {weak_rules.PRIOR_BOUNDS[0]}e0), {weak_rules.PRIOR_BOUNDS[1]}e0) AS prior,
  {', '.join(f"{accuracy(r, 'p', 1)} AS g_{r}, {accuracy(r, '(1e0 - p)', -1)} AS b_{r}" for r in rules)}
  FROM (SELECT pat.*, 1e0 / (1e0 + exp(-({odds}))) AS p FROM pat, e{k - 1}))"""
    failed = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
    return out + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed,
  NOT {failed} AND 1e0 / (1e0 + exp(-({odds}))) >= {weak_rules.KEEP_FROM} AS kept FROM q, e{weak_rules.ROUNDS}"""


def jaccard_sql(words: int = 4, threshold: int = 85) -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, w[i:i + {words - 1}] AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(
    CAST(len(w) AS BIGINT) - {words - 1}, 1))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY ALL),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS overlap FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * overlap >= {threshold} * (x.n + y.n - overlap)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT a, b FROM u UNION SELECT c.a, u.b FROM c JOIN u ON c.b = u.a)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, least(t.doc_id, coalesce(m.low, t.doc_id)) AS component_id
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM c GROUP BY ALL) m USING (doc_id)"""


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def lines_sql() -> str:
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT row, doc_id, i, lines[i] AS line, translate(trim(lines[i], {white}), {_LETTERS}) AS key
    FROM (SELECT row, doc_id, lines, unnest(generate_series(1, len(lines))) AS i FROM d)),
k AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= {line_dedup.LEAST_CHARS} GROUP BY key
    HAVING count(DISTINCT doc_id) >= {line_dedup.LEAST_DOCS}),
m AS (SELECT row, l.doc_id, i, line, keeper IS NOT NULL AND keeper <> l.doc_id AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY row, doc_id"""


def search_sql() -> str:
    terms = rf"regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '{lexical_search.TERM}')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {terms} AS t FROM documents),
s AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS terms FROM d WHERE len(t) > 0),
i AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
f AS (SELECT row, doc_id, len(t) AS n, term, count(*) AS tf FROM (SELECT row, doc_id, t, unnest(t) AS term FROM d)
    SEMI JOIN i USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, docs),
g AS (SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))) AS gain
    FROM f JOIN w USING (term), s),
r AS (SELECT item_id, row, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM i JOIN g USING (term) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= {lexical_search.TOP}"""


def collocations_sql() -> str:
    c = collocations
    return rf"""
WITH p AS (SELECT coalesce(lang, '{c.NO_LANG}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {_LETTERS}),
    '[.,;:!?
-]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m,
    unnest(generate_series(1, len(w) - m + 1)) AS i FROM w, (VALUES (1), (2), (3)) v(m))),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
x AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= {c.LEAST}),
k AS (SELECT lang, m, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
    FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM x)),
s AS (SELECT k.lang, k.m, k.phrase, a, k, l.f AS l, r.f AS r,
    CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
    FROM k JOIN f l ON l.lang = k.lang AND l.phrase = head JOIN f r ON r.lang = k.lang AND r.phrase = rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (SELECT lang, phrase, max(a) AS held FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '),
    array_to_string(w[2:3], ' ')]) AS phrase FROM x WHERE m = 3) GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
    FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE coalesce(100 * held < {c.SUBSUMED} * a, true))
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= {c.TOP}"""


SQL = {
    "op3_weak_supervision": quality_sql(),
    "op6_ngram_jaccard": jaccard_sql(),
    "op10_source_mix": mixing_sql(),
    "op11_line_runs": lines_sql(),
    "op12_lexical_scan": search_sql(),
    "op13_collocations": collocations_sql(),
}
