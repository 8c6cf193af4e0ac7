"""Chunking as SQL: folds over lists. The last element of a fold's list is what is held, all others are done."""

from __future__ import annotations


def chunks_sql(clean: str, strip, tokens: str, size: int = 1024, least: int = 50, most: int = 10_000, late: float = 0.7, texts: str = "documents") -> str:
    """clean: the cleaned `text`; strip and tokens: expressions of a text's stripped form and its token count."""

    def parts(text: str, pattern: str, by: str) -> str:
        return f"list_filter(list_transform(string_split(regexp_replace({text}, '{pattern}', {by}, 'g'), chr(1)), lambda u: {strip('u')}), lambda u: u <> '')"

    def grown(held: str, between: str, unit: str) -> str:
        return f"CASE WHEN {held} = '' THEN {unit} ELSE {held} || {between} || {unit} END"

    sentence = grown("a[-1]", "' '", "s[1]")
    sentences = parts("p[1]", r"([.!?])\s+", r"'\1' || chr(1)")
    inside = f"list_reduce(list_transform({sentences}, lambda u: [u]), lambda a, s: CASE WHEN length({sentence}) <= {size} THEN list_concat(a[:-2], [{sentence}]) ELSE list_concat(a, s) END, list_append(acc, ''))"
    paragraph = grown("acc[-1]", "chr(10) || chr(10)", "p[1]")
    packed = f"list_reduce(list_transform({parts('c', chr(92) + 'n' + chr(92) + 'n+', 'chr(1)')}, lambda u: [u]), lambda acc, p: CASE WHEN length({paragraph}) <= {size} THEN list_concat(acc[:-2], [{paragraph}]) ELSE {inside} END, [''])"
    # How many characters after the last space a piece may lose to it, and where it is cut.
    behind = f"instr(reverse(substr(r[-1], 1, {size})), ' ')"
    at = f"CASE WHEN {behind} > 0 AND {size} - {behind} > {size} * {late} THEN {size} - {behind} ELSE {size} END"
    cut = f"""list_filter(list_reduce(list_transform(range(2 * length(t) // {size} + 2), lambda i: ['']), lambda r, i: CASE WHEN length(r[-1]) <= {size} THEN r
ELSE list_concat(r[:-2], [{strip(f'substr(r[-1], 1, {at})')}, {strip(f'substr(r[-1], {at} + 1)')}]) END, [t]), lambda x: x <> '')"""
    before = "start + coalesce(list_sum(list_transform(ps[1:k - 1], lambda x: length(x) + 1)), 0)"
    return f"""WITH parts AS (SELECT doc_id, list_filter({packed}, lambda t: t <> '') AS ts FROM (SELECT doc_id, {clean} AS c FROM {texts} WHERE text IS NOT NULL)),
placed AS (SELECT doc_id, i, ts[i] AS t, coalesce(list_sum(list_transform(ts[1:i - 1], lambda x: length(x))), 0) AS start FROM (SELECT doc_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM parts)),
cuts AS (SELECT doc_id, i, t, start, CASE WHEN length(t) > {size} THEN {cut} ELSE [t] END AS ps FROM placed),
pieces AS (SELECT doc_id, i, length(t) > {size} AS long, list_transform(ps, lambda p, k: {{'t': p, 's': {before}, 'e': CASE WHEN k = len(ps) THEN start + length(t) ELSE {before} + length(p) END, 'n': {tokens.format('p')}}}) AS ps FROM cuts),
folded AS (SELECT doc_id, list_reduce(list(ps ORDER BY i), lambda acc, x: CASE WHEN len(x) > 1 OR length(x[1].t) >= {least} THEN list_concat(acc, x)
WHEN len(acc) > 0 AND length(acc[-1].t) + length(x[1].t) < {size} THEN list_concat(acc[:-2], [{{'t': acc[-1].t || chr(10) || chr(10) || x[1].t, 's': acc[-1].s, 'e': x[1].e, 'n': acc[-1].n}}]) ELSE acc END, list_filter(first(ps), lambda x: false)) AS cs FROM pieces GROUP BY doc_id)
SELECT doc_id, CAST(i - 1 AS INT) AS chunk_index, cs[i].t AS content, CAST(cs[i].s AS INT) AS start_char, CAST(cs[i].e AS INT) AS end_char, CAST(cs[i].n AS INT) AS tokens,
concat_ws(' ', CASE WHEN i > 1 THEN '...' || right(cs[i - 1].t, 100) END, CASE WHEN i < len(cs) THEN left(cs[i + 1].t, 100) || '...' END) AS context, sha256(cs[i].t) AS content_hash
FROM (SELECT doc_id, cs, unnest(range(1, least(len(cs), {most}) + 1)) AS i FROM folded)"""
