"""DuckDB SQL for the rows of the queries in ngramforge.plans.queries.

Entropies are summed over the children with the parent's total from a join, not by the rewritten
sum that the engine aggregates; undefined is NULL in both.
"""

from __future__ import annotations

from ngramforge.functions.tokens import CATEGORIES, CJK, CJK_CLASS
from ngramforge.plans.queries import CJK_FROM, CJK_TO, DIGITS, LENGTH, LONG, NBEST, ORDER, TOP

START, END, SEP = "chr(57387)", "chr(57389)", "chr(31)"
_WORDS = r"regexp_extract_all(lower(value), '[\p{L}\p{N}_]+')"
_LINES = "SELECT doc_id, (generate_subscripts(v, 1) - 1)::INT AS line, unnest(v) AS value FROM (SELECT doc_id, string_split(text, chr(10)) AS v FROM documents WHERE text IS NOT NULL)"
_ITEM_LINES = "SELECT doc_id, (generate_subscripts(v, 1) - 1)::INT AS line, unnest(v) AS value FROM (SELECT item_id AS doc_id, string_split(text, chr(10)) AS v FROM benchmark WHERE text IS NOT NULL)"
#: Sentences: tokens, freq and ids; n where it is not that of the model.
DOCUMENTS = f"SELECT doc_id, line, {_WORDS} AS tokens, 1 AS freq FROM ({_LINES})"
ITEMS = f"SELECT doc_id, line, {_WORDS} AS tokens, 1 AS freq FROM ({_ITEM_LINES})"
WEIGHTED = f"SELECT {_WORDS} AS tokens, 1 + doc_id % 3 AS freq FROM ({_LINES})"
OVERRIDDEN = f"SELECT {_WORDS} AS tokens, 1 AS freq, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE {LENGTH} END AS n FROM ({_LINES})"
EVENTS = "SELECT user_id, list(event_type ORDER BY ts, event_id) AS tokens, 1 AS freq FROM events GROUP BY user_id"
TURNS = "SELECT conv_id, list(role ORDER BY turn) AS tokens, 1 AS freq FROM conversations GROUP BY conv_id"

NAME = f"replace(g, {SEP}, ' ')"


def _r(value: str) -> str:
    return f"round({value}, {DIGITS}) + 0.0"


def counted(sentences: str, length: int = LENGTH) -> str:
    """Tables pad and cnt (k, g, c, bc, p, s, pp, ss, f, l): the n-gram, its counts, all but its last and its first token, all but two of each side, its first and last one.

    n-grams are strings of their tokens, of which none holds the separator.
    """
    n = "n" if " AS n " in sentences else f"{length} AS n"
    ahead = ", ".join(f"unnest(t[{k}:]) AS t{k}" for k in range(2, max(length, 2) + 1))

    def gram(a: int, b: int) -> str:
        return f" || {SEP} || ".join(f"t{k}" for k in range(a, b + 1)) or "''"

    each = " UNION ALL ".join(
        f"SELECT {k} AS k, {gram(1, k)} AS g, {'CASE WHEN t2 IS NULL THEN 0 ELSE freq END' if k == 1 else 'freq'} AS fw, {'CASE WHEN i = 1 THEN 0 ELSE freq END' if k == 1 else 'freq'} AS bw, "
        f"{gram(1, k - 1)} AS p, {gram(2, k)} AS s, {gram(1, k - 2)} AS pp, {gram(3, k)} AS ss, t1 AS f, t{k} AS l FROM tok WHERE t{k} IS NOT NULL AND {k} <= n"
        for k in range(1, length + 1)
    )
    return f"""
pad AS MATERIALIZED (SELECT list_concat([{START}], tokens, [{END}]) AS t, freq, {n} FROM ({sentences}) WHERE len(tokens) > 0),
tok AS MATERIALIZED (SELECT unnest(t) AS t1, {ahead}, generate_subscripts(t, 1) AS i, freq, n FROM pad),
win AS ({each}),
cnt AS MATERIALIZED (SELECT k::INT AS k, g, sum(fw)::BIGINT AS c, sum(bw)::BIGINT AS bc, any_value(p) AS p, any_value(s) AS s, any_value(pp) AS pp, any_value(ss) AS ss, any_value(f) AS f, any_value(l) AS l FROM win GROUP BY k, g
        UNION ALL SELECT 0, '', sum(freq * (len(t) - 1))::BIGINT, sum(freq * (len(t) - 1))::BIGINT, NULL, NULL, NULL, NULL, NULL, NULL FROM pad HAVING count(*) > 0)"""


#: Tables h (d, k, g, h, q), v (d, k, g, h, ev), nrm (d, k, m, s) and avg2 (k, g, entropy, ev, autonomy, centred) over cnt.
MEASURED = f"""
kid AS (SELECT 'forward' AS d, k - 1 AS k, p AS g, pp AS q, c, l IN ({START}, {END}) AS t FROM cnt WHERE k > 0 AND c > 0
        UNION ALL SELECT 'backward', k - 1, s, ss, bc, f IN ({START}, {END}) FROM cnt WHERE k > 0 AND bc > 0),
all_of AS (SELECT d, k, g, sum(c)::DOUBLE AS n FROM kid GROUP BY d, k, g),
h AS MATERIALIZED (SELECT d, k, g, any_value(q) AS q, sum(CASE WHEN t THEN c / n * log2(n) ELSE -c / n * log2(c / n) END) + 0.0 AS h FROM kid JOIN all_of USING (d, k, g) GROUP BY d, k, g),
v AS MATERIALIZED (SELECT x.d, x.k, x.g, x.h, CASE WHEN x.h <> 0 OR y.h <> 0 THEN x.h - y.h END AS ev FROM h x JOIN h y ON x.d = y.d AND y.k = x.k - 1 AND y.g = x.q),
nrm AS (SELECT d, k, avg(ev) AS m, CASE WHEN stddev_pop(ev) < 1e-12 THEN 0 ELSE stddev_pop(ev) END AS s FROM v WHERE ev IS NOT NULL GROUP BY d, k),
sco AS (SELECT v.*, CASE WHEN s > 0 THEN (ev - m) / s END AS a, ev - m AS ce FROM v LEFT JOIN nrm USING (d, k)),
avg2 AS MATERIALIZED (SELECT k, g, sum(h) / 2 AS entropy, CASE WHEN count(ev) = 2 THEN sum(ev) / 2 END AS ev, CASE WHEN count(a) = 2 THEN sum(a) / 2 END AS autonomy, CASE WHEN count(ce) = 2 THEN sum(ce) / 2 END AS centred
         FROM sco GROUP BY k, g HAVING count(*) = 2)"""


def _counts(sentences: str, select: str, length: int = LENGTH) -> str:
    return f"WITH {counted(sentences, length)} {select}"


def _measures(sentences: str, select: str, length: int = LENGTH) -> str:
    return f"WITH {counted(sentences, length)}, {MEASURED} {select}"


ALL = f"SELECT k, {NAME} AS ngram, c AS count, bc AS back_count FROM cnt"
MARK = f"(f IN ({START}, {END}) OR l IN ({START}, {END}))"


def _segmented(sentences: str, ids: str, corpus: str, select: str, length: int = LENGTH) -> str:
    """Table seg (ids, words) of the best segmentation: a row for each position, which keeps the sums of the last ones, then back along the lengths.

    Of sums within 1e-7 the one of the shorter last word is taken.
    """
    order = length - 1
    sums = ", ".join(f"b[{j}] + sc[(i - 1) * {order} + {j}] AS s{j}" for j in range(1, order + 1))
    steps, top, word = "", "s1", "1"
    for j in range(2, order + 1):
        steps = f"SELECT *, CASE WHEN s{j} > {top} + 1e-7 THEN s{j} ELSE {top} END AS top{j}, CASE WHEN s{j} > {top} + 1e-7 THEN {j} ELSE {word} END AS word{j} FROM ({steps or '@'})"
        top, word = f"top{j}", f"word{j}"
    step = steps.replace("@", f"SELECT {ids}, i, n, sc, b, ks, {sums} FROM dp WHERE i <= n")
    return f"""WITH RECURSIVE {counted(corpus, length)}, {MEASURED},
line AS (SELECT {ids}, tokens FROM ({sentences}) WHERE len(tokens) > 0),
span AS (SELECT {ids}, i, j, CASE WHEN j <= i THEN array_to_string(tokens[i - j + 1 : i], {SEP}) END AS g FROM (SELECT {ids}, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM line), range(1, {order} + 1) AS lengths(j)),
scs AS MATERIALIZED (SELECT {ids}, list(CASE WHEN j <= i THEN coalesce(round(autonomy, 9), -100.0) * j END ORDER BY i, j) AS sc FROM span LEFT JOIN avg2 ON avg2.k = j AND avg2.g = span.g GROUP BY {ids}),
dp AS (SELECT {ids}, 1 AS i, len(tokens) AS n, sc, [0.0::DOUBLE] AS b, []::INT[] AS ks FROM line JOIN scs USING ({ids})
       UNION ALL
       SELECT {ids}, i + 1, n, sc, list_prepend({top}, b)[1 : {order}], list_append(ks, {word}) FROM ({step})),
back AS (SELECT {ids}, n AS pos, ks, []::INT[] AS ends FROM dp WHERE i = n + 1
         UNION ALL
         SELECT {ids}, pos - ks[pos], ks, list_prepend(pos::INT, ends) FROM back WHERE pos > 0),
seg AS (SELECT {ids}, list_transform(range(1, len(ends) + 1), lambda w: tokens[CASE WHEN w = 1 THEN 1 ELSE ends[w - 1] + 1 END : ends[w]]) AS words FROM back JOIN line USING ({ids}) WHERE pos = 0)
{select}"""


def _several(sentences: str, ids: str, corpus: str, select: str, nbest: int, length: int = LENGTH) -> str:
    """Table many (ids, rank, score, words) of the best segmentations between the markers: each position's row keeps the best few of the last ones.

    Of equal sums the longer last word, then the better beginning, comes last.
    """
    order = length - 1
    ways = ", ".join(f"CASE WHEN {j} <= i THEN list_transform(range(1, len(b[{j}]) + 1), lambda r: {{'key': round(b[{j}][r].score + sc[(i - 1) * {order} + {j}], 7), 'j': {j}, 'r': r, 'score': b[{j}][r].score + sc[(i - 1) * {order} + {j}], 'ends': list_append(b[{j}][r].ends, i::INT)}}) END" for j in range(1, order + 1))
    return f"""WITH RECURSIVE {counted(corpus, length)}, {MEASURED},
line AS (SELECT {ids}, list_concat([{START}], tokens, [{END}]) AS tokens FROM ({sentences}) WHERE tokens IS NOT NULL),
span AS (SELECT {ids}, i, j, CASE WHEN j <= i THEN array_to_string(tokens[i - j + 1 : i], {SEP}) END AS g FROM (SELECT {ids}, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM line), range(1, {order} + 1) AS lengths(j)),
scs AS MATERIALIZED (SELECT {ids}, list(CASE WHEN j <= i THEN coalesce(round(autonomy, 9) * j, -100.0) END ORDER BY i, j) AS sc FROM span LEFT JOIN avg2 ON avg2.k = j AND avg2.g = span.g GROUP BY {ids}),
dp AS (SELECT {ids}, 1::BIGINT AS i, len(tokens) AS n, sc, [[{{'score': 0.0::DOUBLE, 'ends': []::INT[]}}]] AS b FROM line JOIN scs USING ({ids})
       UNION ALL
       SELECT {ids}, i + 1, n, sc, list_prepend(list_transform(list_sort(flatten([{ways}]))[-{nbest}:], lambda x: {{'score': x.score, 'ends': x.ends}}), b)[1 : {order}] FROM dp WHERE i <= n),
best AS (SELECT {ids}, (generate_subscripts(b[1], 1) - 1)::INT AS rank, unnest(b[1]) AS x FROM dp WHERE i = n + 1),
many AS (SELECT {ids}, rank, x.score AS score, list_transform(range(2, len(x.ends)), lambda w: tokens[x.ends[w - 1] + 1 : x.ends[w]]) AS words FROM best JOIN line USING ({ids}))
{select}"""


_BOTH = f"SELECT tokens, freq FROM ({DOCUMENTS}) UNION ALL SELECT tokens, freq FROM ({ITEMS})"
_SEGMENTED = "SELECT doc_id, line, array_to_string(list_transform(words, lambda w: array_to_string(w, '_')), ' ') AS segmented FROM seg"
_LETTER = "CASE WHEN len(w) = 1 THEN 'S' WHEN i = 1 THEN 'B' WHEN i = len(w) THEN 'E' ELSE 'I' END"
_BIES = f"list_transform(range(1, len(w) + 1), lambda i: w[i] || '-' || {_LETTER})"
_INSIDE = "w[i] || '-' || array_to_string(w[1 : i - 1], '') || '_' || array_to_string(w[i + 1 : len(w)], '')"
_PAIRS = f"pairs AS (SELECT doc_id, line, list_transform(range(0, (len(tokens) + 1) // 2), lambda p: tokens[2 * p + 1 : 2 * p + 2]) AS words FROM ({ITEMS}) WHERE len(tokens) > 0)"


def _tagged(each: str) -> str:
    return f"WITH {_PAIRS} SELECT doc_id, line, array_to_string(flatten(list_transform(words, lambda w: {each})), ' ') AS tagged FROM pairs"


_RUN = r"[\p{Lu}\p{Ll}]+" + "".join(f"|\\p{{{c}}}+" for c in CATEGORIES)
_SPACES = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_IS_CJK = f"regexp_matches(p, '^[{CJK_CLASS}]')"
_PIECES = f"SELECT item_id, (generate_subscripts(r, 1) - 1)::INT AS run, unnest(r) AS p FROM (SELECT item_id, regexp_extract_all(translate(text, '{CJK_FROM}', '{CJK_TO}'), '{_RUN}') AS r FROM benchmark)"
_CATEGORY = "CASE WHEN regexp_matches(p, '^[\\p{Lu}\\p{Ll}]') THEN 'latin' " + " ".join(f"WHEN regexp_matches(p, '^\\p{{{c}}}') THEN '{c}'" for c in CATEGORIES) + " END"
_CJK = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK)
assert _CJK == CJK_CLASS

_PRUNED = "SELECT k, g, CASE WHEN k = 0 THEN c ELSE greatest(c - 1, 0) END AS c, CASE WHEN k = 0 THEN bc ELSE greatest(bc - 1, 0) END AS bc FROM cnt"
_LEFT = "WHERE k = 0 OR c > 0 OR bc > 0"
_BEFORE = "SELECT DISTINCT k - 1 AS k, p AS g FROM cnt WHERE k > 0 AND c > 0"
_SCORED = "FROM avg2 JOIN cnt USING (k, g) WHERE autonomy IS NOT NULL"


def _lost(from_: str, most: str) -> str:
    """Table lost (k, g, x): how many of that table's n-grams each of their beginnings has, up to most tokens."""
    return f"lost AS (SELECT u::INT AS k, array_to_string(string_split(g, {SEP})[1:u], {SEP}) AS g, count(*)::BIGINT AS x FROM (SELECT k, g, unnest(range(0, {most} + 1)) AS u FROM {from_}) GROUP BY 1, 2)"


ORACLES: dict[str, str] = {
    "ngram_count": _counts(DOCUMENTS, ALL),
    "ngram_count_weighted": _counts(WEIGHTED, ALL),
    "ngram_length_override": _counts(OVERRIDDEN, ALL),
    "ngram_count_long": _counts(DOCUMENTS, ALL, LONG),
    "root_count": _counts(DOCUMENTS, "SELECT c AS count, bc AS back_count FROM cnt WHERE k = 0"),
    "unigram_boundary": _counts(DOCUMENTS, f"SELECT CASE WHEN g = {START} THEN 'start' ELSE 'end' END AS marker, c AS count, bc AS back_count FROM cnt WHERE k = 1 AND {MARK}"),
    "vocabulary": _counts(DOCUMENTS, f"SELECT k, {NAME} AS ngram, c AS count FROM cnt WHERE k > 0 AND c > 0"),
    "vocabulary_unmarked": _counts(DOCUMENTS, f"SELECT k, {NAME} AS ngram, c AS count FROM cnt WHERE k > 0 AND c > 0 AND NOT {MARK}"),
    "leaf_ngrams": _counts(DOCUMENTS, f"SELECT k, {NAME} AS ngram, c AS count FROM cnt ANTI JOIN ({_BEFORE}) USING (k, g) WHERE k > 0 AND c > 0"),
    "max_depth": _counts(DOCUMENTS, "SELECT max(k) AS depth FROM cnt"),
    "prune": _counts(DOCUMENTS, f"SELECT k, {NAME} AS ngram, c AS count, bc AS back_count FROM ({_PRUNED}) {_LEFT}"),
    "prune_leafwise": _counts(
        DOCUMENTS,
        f""", leaf AS (SELECT k, g FROM cnt ANTI JOIN ({_BEFORE}) USING (k, g) WHERE k > 0 AND c > 0), {_lost("leaf", "k")}
SELECT k, {NAME} AS ngram, c - coalesce(x, 0) AS count FROM cnt LEFT JOIN lost USING (k, g) WHERE k = 0 OR (c > 0 AND c > coalesce(x, 0))""",
    ),
    "prune_hapax": _counts(
        DOCUMENTS,
        f""", once AS (SELECT k, g, k - 1 AS pk, p FROM cnt WHERE k > 0 AND c = 1), found AS (SELECT k AS pk, g AS p FROM once),
top AS (SELECT k, g FROM once ANTI JOIN found USING (pk, p)), {_lost("top", "k - 1")}
SELECT k, {NAME} AS ngram, c - coalesce(x, 0) AS count FROM cnt LEFT JOIN lost USING (k, g) WHERE k = 0 OR (c > 1 AND c > coalesce(x, 0))""",
    ),
    "prune_then_add": f"""WITH {counted(DOCUMENTS)}, one AS (SELECT * FROM ({_PRUNED}) {_LEFT}), two AS (WITH {counted(ITEMS)} SELECT k, g, c, bc FROM cnt)
SELECT k, {NAME} AS ngram, sum(c)::BIGINT AS count, sum(bc)::BIGINT AS back_count FROM (SELECT k, g, c, bc FROM one UNION ALL SELECT * FROM two) GROUP BY k, g""",
    "merge_models": _counts(_BOTH, ALL),
    "model_store": _counts(_BOTH, ALL),
    "stream_training": _counts(ITEMS, f"SELECT k, {NAME} AS ngram, c AS count, bc AS back_count FROM ({_PRUNED}) {_LEFT}"),
    "stream_counts": _counts(ITEMS, ALL),
    "bare_trie": f"""WITH s AS (SELECT tokens AS t FROM ({TURNS})), w AS (SELECT t[1:u] AS g FROM (SELECT t, unnest(range(0, len(t) + 1)) AS u FROM s))
SELECT len(g)::INT AS k, array_to_string(g, ' ') AS ngram, count(*) AS count FROM w GROUP BY g""",
    "merge_counts": "SELECT name, sum(n)::BIGINT AS count FROM (SELECT event_type AS name, 2 * count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT role, count(*) FROM conversations GROUP BY 1) GROUP BY name",
    "fwd_entropy": _measures(DOCUMENTS, f"SELECT k, {NAME} AS ngram, {_r('h')} AS entropy FROM h WHERE d = 'forward'"),
    "bwd_entropy": _measures(DOCUMENTS, f"SELECT k, {NAME} AS ngram, {_r('h')} AS entropy FROM h WHERE d = 'backward'"),
    "entropy_avg": _measures(DOCUMENTS, f"SELECT k, {NAME} AS ngram, {_r('entropy')} AS entropy FROM avg2"),
    "ev": _measures(DOCUMENTS, f"SELECT k, {NAME} AS ngram, {_r('ev')} AS ev FROM avg2"),
    "norm_vector": _measures(
        DOCUMENTS,
        f"SELECT direction, lengths.k::INT AS k, {_r('coalesce(m, 0.0)')} AS mean, {_r('coalesce(s, 0.0)')} AS stdev FROM (VALUES ('forward'), ('backward')) AS dirs(direction), range(1, {LENGTH} + 1) AS lengths(k) LEFT JOIN nrm ON nrm.d = direction AND nrm.k = lengths.k",
    ),
    "autonomy": _measures(DOCUMENTS, f"SELECT k, {NAME} AS ngram, {_r('autonomy')} AS autonomy FROM avg2"),
    "autonomy_long": _measures(DOCUMENTS, f"SELECT k, {NAME} AS ngram, {_r('entropy')} AS entropy, {_r('autonomy')} AS autonomy FROM avg2", LONG),
    "autonomy_centred": _measures(DOCUMENTS, f"SELECT k, {NAME} AS ngram, {_r('centred')} AS centred FROM avg2"),
    "root_entropy": _measures(DOCUMENTS, f"SELECT {_r('avg(h)')} AS entropy FROM h WHERE k = 0"),
    "event_ngrams": _counts(EVENTS, ALL),
    "event_autonomy": _measures(EVENTS, f"SELECT k, {NAME} AS ngram, {_r('entropy')} AS entropy, {_r('ev')} AS ev, {_r('autonomy')} AS autonomy FROM avg2"),
    "turn_ngrams": _counts(TURNS, ALL),
    "lookup": _measures(
        DOCUMENTS,
        f""", cand AS (SELECT DISTINCT k::INT AS k, array_to_string(tokens[i : i + k - 1], {SEP}) AS g FROM (SELECT tokens, unnest(range(1, len(tokens) + 1)) AS i FROM ({ITEMS})), range(1, {LENGTH} + 1) AS lengths(k) WHERE i + k - 1 <= len(tokens))
SELECT {NAME} AS ngram, coalesce(c, 0) AS count, {_r('entropy')} AS entropy, {_r('ev')} AS ev, {_r('autonomy')} AS autonomy, {_r('centred')} AS centred FROM cand LEFT JOIN cnt USING (k, g) LEFT JOIN avg2 USING (k, g)""",
    ),
    "lexicon_spans": _measures(DOCUMENTS, f"SELECT {NAME} AS ngram, {_r('autonomy')} AS autonomy, c AS count {_SCORED} AND NOT {MARK}"),
    "lexicon_topk": _measures(DOCUMENTS, f"SELECT {NAME} AS ngram, {_r('autonomy')} AS autonomy, c AS count {_SCORED} AND c > 0 ORDER BY 2 DESC, 1 LIMIT {TOP}"),
    "lexicon_topk_long": _measures(DOCUMENTS, f"SELECT {NAME} AS ngram, {_r('autonomy')} AS autonomy, c AS count {_SCORED} AND c > 0 ORDER BY 2 DESC, 1 LIMIT {TOP}", LONG),
    "lexicon_lines": _measures(EVENTS, f"SELECT format('{{}}{{}}{{:.5f}}', {NAME}, chr(9), autonomy) AS value {_SCORED} AND c > 0"),
    "model_csv_roundtrip": _measures(EVENTS, f"SELECT k, {NAME} AS ngram, {_r('autonomy')} AS autonomy, c AS count {_SCORED} AND c > 0"),
    "model_csv_characters": _measures(f"SELECT string_split(p, '') AS tokens, 1 AS freq FROM ({_PIECES}) WHERE {_IS_CJK}", f"SELECT k, {NAME} AS ngram, {_r('autonomy')} AS autonomy, c AS count {_SCORED} AND c > 0 AND NOT {MARK}"),
    "unicode_tokenize": f"WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_RUN}')) AS p FROM documents) SELECT doc_id, count(*) AS runs, sum(length(p))::BIGINT AS characters, max(length(p))::INT AS longest FROM r GROUP BY doc_id",
    "unicode_category": f"WITH r AS (SELECT unnest(regexp_extract_all(text, '{_RUN}')) AS p FROM documents) SELECT {_CATEGORY} AS category, count(*) AS runs FROM r GROUP BY 1",
    "cjk_filter": f"WITH b AS (SELECT item_id, '我们 ' || replace(text, 'a', ' 中文' || chr(131072) || ' ') || '々〇' AS text FROM benchmark) SELECT item_id, array_to_string(list_filter(regexp_extract_all(text, '{_RUN}'), lambda p: regexp_matches(p, '^[{_CJK}]')), '|') AS chunks FROM b",
    "whitespace_tokens": f"SELECT doc_id, len(list_filter(string_split_regex(text, '{_SPACES}+'), lambda t: t <> ''))::INT AS words, len(string_split(text, ' '))::INT AS parts, length(text)::INT AS characters FROM documents",
    "blank_lines": f"SELECT doc_id, sum((NOT regexp_matches(value, '[^{_SPACES[1:-1]}]'))::INT)::BIGINT AS blank, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM documents) GROUP BY doc_id",
    "nfc": "SELECT conv_id, turn, nfc_normalize(replace(text, 'e', 'e' || chr(769))) AS text FROM conversations",
    "bies_tags": _tagged(_BIES),
    "token_in_word": _tagged(f"list_transform(range(1, len(w) + 1), lambda i: {_INSIDE})"),
    "token_in_word_bies": _tagged(f"list_transform(range(1, len(w) + 1), lambda i: {_INSIDE} || '-' || {_LETTER})"),
    "add_bies": f"SELECT DISTINCT x AS word, array_to_string(list_transform(range(1, length(x) + 1), lambda i: x[i] || '-' || CASE WHEN length(x) = 1 THEN 'S' WHEN i = 1 THEN 'B' WHEN i = length(x) THEN 'E' ELSE 'I' END), ' ') AS tagged FROM (SELECT unnest(tokens) AS x FROM ({ITEMS}))",
    "segment": _segmented(DOCUMENTS, "doc_id, line", DOCUMENTS, _SEGMENTED),
    "segment_joined": _segmented(ITEMS, "doc_id, line", DOCUMENTS, _SEGMENTED),
    "segment_stream": _segmented(ITEMS, "doc_id, line", ITEMS, _SEGMENTED),
    "segment_long": _segmented(ITEMS, "doc_id, line", DOCUMENTS, _SEGMENTED, LONG),
    "bies_long": _segmented(ITEMS, "doc_id, line", DOCUMENTS, f"SELECT doc_id, line, array_to_string(flatten(list_transform(words, lambda w: {_BIES})), ' ') AS tagged FROM seg", LONG),
    "segment_nbest": _several(EVENTS, "user_id", EVENTS, f"SELECT user_id, rank, {_r('score')} AS score, array_to_string(list_transform(words, lambda w: array_to_string(w, '_')), ' ') AS segmented FROM many", NBEST),
    "nbest_lines": _several(EVENTS, "user_id", EVENTS, "SELECT user_id, rank, array_to_string(list_transform(words, lambda w: array_to_string(w, '')), '  ') AS value FROM many", NBEST),
    "segment_preprocessed": _segmented(
        f"SELECT item_id, run, string_split(p, '') AS tokens FROM ({_PIECES}) WHERE {_IS_CJK}",
        "item_id, run",
        f"SELECT string_split(p, '') AS tokens, 1 AS freq FROM ({_PIECES}) WHERE {_IS_CJK}",
        f"""SELECT item_id, string_agg(out, ' ' ORDER BY run) AS segmented FROM (
SELECT item_id, run, array_to_string(flatten(list_transform(words, lambda w: {_BIES})), ' ') AS out FROM seg
UNION ALL SELECT item_id, run, array_to_string({_BIES}, ' ') FROM (SELECT item_id, run, string_split(p, '') AS w FROM ({_PIECES}) WHERE NOT {_IS_CJK})) GROUP BY item_id""",
    ),
    "segment_events": _segmented(EVENTS, "user_id", EVENTS, f"SELECT user_id, array_to_string(flatten(list_transform(words, lambda w: {_BIES})), ' ') AS tagged FROM seg"),
    "tag_sentences": _segmented(
        f"SELECT doc_id AS item_id, line, string_split(value, ' ') AS tokens FROM ({_ITEM_LINES})",
        "item_id, line",
        DOCUMENTS,
        f"SELECT item_id, line, array_to_string(flatten(list_transform(words, lambda w: list_transform(range(1, len(w) + 1), lambda i: {_INSIDE} || '-' || {_LETTER}))), ' ') AS tagged FROM seg",
    ),
}
