"""DuckDB SQL restatements of the registered queries (the correctness oracle).

Each restatement is written independently of the Spark plan: brute-force
regex matching of every sentence against every term, self-joins instead of
collected arrays, window functions instead of salted top-n. Only the fixed
patterns are shared (RE2 forms of the Java patterns in functions/patterns.py).
"""

from __future__ import annotations

from stereoscope.sources.specs import BiasSpec


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def spec_values(spec: BiasSpec, name: str = "spec_terms") -> str:
    rows = ", ".join(f"({q(s)}, {q(a)}, {side}, {pos}, {q(t)})" for s, a, side, _, pos, t in spec.rows())
    return f"{name}(spec, axis, side, pos, term) AS (VALUES {rows})"


SENTS = r"""
split_parts AS (
  SELECT doc_id, unnest(p) AS raw, generate_subscripts(p, 1) AS idx
  FROM (SELECT doc_id, regexp_split_to_array(text, '[.!?\n]+') AS p FROM documents)
),
sents AS (
  SELECT doc_id, CAST(idx - 1 AS INTEGER) AS sent_pos, trim(raw) || '.' AS sentence
  FROM split_parts WHERE length(trim(raw)) >= 1
)"""

# sentences by their words: a term stands in a sentence only if its first word does
SENT_WORDS = r"""
sent_words AS MATERIALIZED (SELECT *, unnest(list_distinct(regexp_split_to_array(lower(sentence), '[ .,!]+'))) AS word FROM sents)"""

MINED = r"""
hits AS MATERIALIZED (
  SELECT t.spec, s.doc_id, s.sent_pos, s.sentence, t.axis, t.side, t.pos, t.term
  FROM (SELECT *, unnest(list_distinct(regexp_split_to_array(lower(sentence), '[ .,!]+'))) AS word FROM sents) s
  JOIN (SELECT *, regexp_split_to_array(lower(term), '[ .,!]+')[1] AS word FROM spec_terms) t
    ON t.word = s.word AND regexp_matches(lower(s.sentence), '(^| )' || lower(t.term) || '[ .,!]')
),
mined AS MATERIALIZED (
  SELECT g.spec, g.doc_id, g.sent_pos, g.sentence,
         g.term AS grp_term, CAST(g.side AS INTEGER) AS grp_side, CAST(g.pos AS INTEGER) AS grp_pos,
         a.term AS att_term, CAST(a.side AS INTEGER) AS att_side, CAST(a.pos AS INTEGER) AS att_pos
  FROM hits g JOIN hits a ON g.spec = a.spec AND g.doc_id = a.doc_id AND g.sent_pos = a.sent_pos
  WHERE g.axis = 'group' AND a.axis = 'attribute'
)"""

PAIR_ID_SQL = "md5(concat_ws('|', m.spec, m.doc_id, m.sent_pos, m.grp_side, m.grp_pos, m.grp_term, m.att_side, m.att_pos, m.att_term)) AS pair_id"
PAIRS = r"""
pairs AS (
  SELECT m.spec, m.doc_id, m.sent_pos,
         md5(concat_ws('|', m.spec, m.doc_id, m.sent_pos, m.grp_side, m.grp_pos, m.grp_term, m.att_side, m.att_pos, m.att_term)) AS pair_id,
         m.sentence,
         regexp_replace(regexp_replace(m.sentence, '(^| )' || lower(m.grp_term) || '([ .,!])', '\1' || p.term || '\2', 'gi'),
                        '(^| )' || lower(m.grp_term) || '([ .,!])', '\1' || p.term || '\2', 'gi') AS alt_sentence,
         m.grp_term AS grp_term_1, p.term AS grp_term_2, m.att_term, m.grp_side, m.grp_pos, m.att_side, m.att_pos
  FROM mined m JOIN spec_terms p
    ON p.spec = m.spec AND p.axis = 'group' AND p.side = 1 - m.grp_side AND p.pos = m.grp_pos
)"""

LABELLED = r"""
att_sides AS (SELECT spec, replace(term, ' ', '-') AS att_key, min(side) AS att_dir_side
              FROM spec_terms WHERE axis = 'attribute' GROUP BY spec, replace(term, ' ', '-')),
grp_sides AS (SELECT spec, term AS gterm, min(side) AS grp_dir_side FROM spec_terms WHERE axis = 'group' GROUP BY spec, term),
labelled AS (
  SELECT p.*,
    CASE WHEN (a.att_dir_side = 0) = (coalesce(g.grp_dir_side, 0) = 0) THEN 'stereotype' ELSE 'anti-stereotype' END AS label_1,
    CASE WHEN (a.att_dir_side = 0) = (coalesce(g.grp_dir_side, 0) = 0) THEN 'anti-stereotype' ELSE 'stereotype' END AS label_2
  FROM pairs p
  JOIN att_sides a ON a.spec = p.spec AND a.att_key = replace(p.att_term, ' ', '-')
  LEFT JOIN grp_sides g ON g.spec = p.spec AND g.gterm = p.grp_term_1
)"""

TOKENS = "['<s>'] || list_filter(regexp_split_to_array(lower({x}), '[^a-z]+'), lambda w: w <> '')"

LM = r"""
corpus AS (
  SELECT trim(raw) || '.' AS sentence
  FROM (SELECT unnest(regexp_split_to_array(text, '[.!?\n]+')) AS raw FROM documents)
  WHERE length(trim(raw)) >= 1
),
corpus_tok AS (SELECT """ + TOKENS.format(x="sentence") + r""" AS t FROM corpus),
corpus_bi AS (
  SELECT t[i] AS w1, t[i + 1] AS w2
  FROM (SELECT t, unnest(generate_series(1, len(t) - 1)) AS i FROM corpus_tok WHERE len(t) > 1)
),
bigrams AS (SELECT w1, w2, count(*) AS c12 FROM corpus_bi GROUP BY w1, w2),
hist AS (SELECT w1, sum(c12) AS c1 FROM bigrams GROUP BY w1),
vocab AS (SELECT CAST(count(DISTINCT w2) AS DOUBLE) AS v FROM bigrams)"""

LOSSES = r"""
variants AS (
  SELECT pair_id, 0 AS variant, sentence AS text, grp_term_1 AS target FROM labelled
  UNION ALL SELECT pair_id, 1 AS variant, alt_sentence AS text, grp_term_2 AS target FROM labelled
),
var_tok AS (SELECT pair_id, variant, """ + TOKENS.format(x="text") + r""" AS t FROM variants),
var_bi AS (
  SELECT pair_id, variant, t[i] AS w1, t[i + 1] AS w2
  FROM (SELECT pair_id, variant, t, unnest(generate_series(1, len(t) - 1)) AS i FROM var_tok WHERE len(t) > 1)
),
losses AS (
  SELECT b.pair_id, CAST(b.variant AS INTEGER) AS variant,
         round(-avg(ln((coalesce(g.c12, 0) + 1.0) / (coalesce(h.c1, 0) + (SELECT v FROM vocab)))), 6) AS loss
  FROM var_bi b
  LEFT JOIN bigrams g ON g.w1 = b.w1 AND g.w2 = b.w2
  LEFT JOIN hist h ON h.w1 = b.w1
  GROUP BY b.pair_id, b.variant
),
causal AS (
  SELECT pair_id, 'bigram-lm' AS model, greatest(l0, l1) - l0 AS r0, greatest(l0, l1) - l1 AS r1
  FROM (SELECT pair_id, max(CASE WHEN variant = 0 THEN loss END) AS l0,
               max(CASE WHEN variant = 1 THEN loss END) AS l1 FROM losses GROUP BY pair_id)
)"""

WINNER = r"""
ranked AS (
  SELECT l.*, c.model, c.r0, c.r1,
         CASE WHEN c.r0 > c.r1 THEN 0 ELSE 1 END AS top, CASE WHEN c.r1 > c.r0 THEN 0 ELSE 1 END AS bottom
  FROM labelled l JOIN causal c ON c.pair_id = l.pair_id
  WHERE c.r0 IS NOT NULL AND c.r1 IS NOT NULL
),
scored AS (
  SELECT *,
    CAST((CASE WHEN top = 0 THEN label_1 ELSE label_2 END) = 'stereotype' AS INTEGER) AS stereotyped,
    CASE WHEN top = 0 THEN grp_term_1 ELSE grp_term_2 END AS top_term,
    CASE WHEN bottom = 0 THEN grp_term_1 ELSE grp_term_2 END AS bottom_term,
    CASE WHEN top = 0 THEN r0 ELSE r1 END AS top_logit,
    CASE WHEN bottom = 0 THEN r0 ELSE r1 END AS bottom_logit
  FROM ranked
)"""


def with_ctes(spec: BiasSpec, *parts: str, body: str) -> str:
    return "WITH " + ",\n".join([spec_values(spec)] + [p.strip() for p in parts]) + "\n" + body


CTE_NAMES = ("split_parts", "sents", "hits", "mined", "pairs", "att_sides", "grp_sides", "labelled")
DOCS_SRC = "FROM documents"
CONV_SRC = "FROM (SELECT 1000000000000 + (conv_id + turn) * (conv_id + turn + 1) // 2 + turn AS doc_id, text FROM conversations)"


def pipeline(spec: BiasSpec, upto: str, src: str | None = None, prefix: str = "") -> list[str]:
    """CTE list up to ``upto``; ``src`` swaps the corpus, ``prefix`` renames the CTEs."""
    import re
    order = [("sents", SENTS), ("mined", MINED), ("pairs", PAIRS), ("labelled", LABELLED),
             ("lm", LM), ("losses", LOSSES), ("scored", WINNER)]
    out = []
    for name, part in order:
        if src is not None:
            part = part.replace(DOCS_SRC, src)
        if prefix:
            part = re.sub(r"\b(" + "|".join(CTE_NAMES) + r")\b", lambda m: prefix + m.group(1), part)
        out.append(part)
        if name == upto:
            break
    return out


def spec_names_cte(name: str = "names", terms: str = "spec_terms") -> str:
    """g1[0]_g2[0]__a1[0]_a2[0]_<url-safe base64 md5 of all terms>."""
    first = lambda ax, sd: (f"replace(max(CASE WHEN axis = '{ax}' AND side = {sd} AND pos = 0 THEN term END), ' ', '-')")  # noqa
    return f"""
{name} AS (SELECT spec, {first('group', 0)} || '_' || {first('group', 1)} || '__' || {first('attribute', 0)} || '_' ||
  {first('attribute', 1)} || '_' || replace(replace(to_base64(unhex(md5(string_agg(term, '' ORDER BY
  CASE WHEN axis = 'group' THEN 0 ELSE 1 END, side, pos)))), '+', '-'), '/', '_') AS bias_name
  FROM {terms} GROUP BY spec)"""


def record_cte(prefix: str = "", name: str = "records") -> str:
    """C11 records over <prefix>labelled with templates."""
    lab = prefix + "labelled"
    return templ_cte(lab).replace("templ_o", prefix + "templ_o").replace("templ_s", prefix + "templ_s") \
        .replace("\ntempl AS", "\n" + prefix + "templ AS") + f""",
{name} AS (
  SELECT l.spec, l.pair_id, l.doc_id, l.sentence, l.alt_sentence, l.grp_term_1 AS org_grp_term, l.att_term,
    {mask("l.sentence", "CASE WHEN instr(lower(l.sentence), lower(l.grp_term_1)) > 0 THEN l.grp_term_1 ELSE l.grp_term_2 END")} AS template,
    t.template AS alt_template, l.grp_term_1 AS grp_term1, l.grp_term_2 AS grp_term2, t.grp_refs, l.label_1, l.label_2,
    n.bias_name AS bias_spec, 'tool' AS type, 'corpus-mining' AS gen_model
  FROM {lab} l JOIN {prefix}templ t ON t.pair_id = l.pair_id JOIN names n ON n.spec = l.spec
)"""


# ------------------------------------------------------------ RE2 restatements
FINAL_PUNCT = r"[!-/:-@\[-`{-~]$"

# FIXED VALUES: the tokeniser subset in RE2 form (same rules as operators/templates.py).
DUCK_TOKENISE = (
    (r"([,;:@#$%&?!()\[\]{}<>" + '"' + r"])", r" \1 "),
    (r"(--|\.\.\.)", r" \1 "),
    (r"([^.])\.([\s" + '"' + r"')\]}]*)$", r"\1 .\2"),
    (r"(?i)(\w)(n't)\b", r"\1 \2"),
    (r"(?i)(\w)('s|'m|'d|'ll|'re|'ve)\b", r"\1 \2"),
)
DUCK_DETOKENISE = (
    (r" ([,.;:?!%)\]}])", r"\1"),
    (r"(?i) (n't|'s|'m|'d|'ll|'re|'ve)\b", r"\1"),
    (r"([(\[{]) ", r"\1"),
)


def add_period(x: str) -> str:
    return f"(CASE WHEN length({x}) = 0 OR regexp_matches({x}, {q(FINAL_PUNCT)}) THEN {x} ELSE {x} || '.' END)"


def mask(s: str, term: str, mark: str = "[T]") -> str:
    x = add_period(f"regexp_replace({s}, '^\"+|\"+$', '', 'g')")
    p = f"('(?:^|( ) *)' || lower({term}) || '[ .,!]*([ .,!])')"
    rep = q("\\1" + mark + "\\2")
    return f"regexp_replace(regexp_replace({x}, {p}, {rep}, 'gi'), {p}, {rep}, 'gi')"


def tokenize(x: str) -> str:
    for pat, rep in DUCK_TOKENISE:
        x = f"regexp_replace({x}, {q(pat)}, {q(rep)}, 'g')"
    return f"list_filter(string_split_regex(trim({x}), ' +'), lambda t: t <> '')"


def detokenize(x: str) -> str:
    x = f"array_to_string({x}, ' ')"
    for pat, rep in DUCK_DETOKENISE:
        x = f"regexp_replace({x}, {q(pat)}, {q(rep)}, 'g')"
    return x


def templ_cte(src: str = "pairs") -> str:
    """E4-E6 per pair: template and grp_refs text."""
    return f"""
templ_o AS (
  SELECT *,
    CASE WHEN instr(lower(sentence), lower(grp_term_1)) > 0 THEN grp_term_1
         WHEN instr(lower(sentence), lower(grp_term_2)) > 0 THEN grp_term_2 END AS tw0,
    CASE WHEN instr(lower(sentence), lower(grp_term_1)) > 0 THEN grp_term_2
         WHEN instr(lower(sentence), lower(grp_term_2)) > 0 THEN grp_term_1 END AS tw1
  FROM {src}
),
templ_s AS (
  SELECT *,
    {tokenize(mask("(CASE WHEN instr(att_term, '-') > 0 AND length(replace(att_term, '-', '')) > 0 THEN replace(sentence, replace(att_term, '-', ''), replace(att_term, '-', ' ')) ELSE sentence END)", "tw0", "*"))} AS st,
    {tokenize(mask("(CASE WHEN instr(att_term, ' ') > 0 AND instr(alt_sentence, replace(att_term, ' ', '')) > 0 THEN replace(alt_sentence, replace(att_term, ' ', ''), att_term) ELSE alt_sentence END)", "tw1", "*"))} AS rt,
    list_distinct([lower(tw0), lower(tw1), lower(replace(tw0, '-', '')), lower(replace(tw1, '-', ''))]) AS tw
  FROM templ_o WHERE tw0 IS NOT NULL
),
templ AS (
  SELECT pair_id,
    replace({detokenize("list_transform(range(1, least(len(st), len(rt)) + 1), lambda i: CASE WHEN st[i] = rt[i] THEN st[i] WHEN list_contains(tw, lower(st[i])) THEN '[T]' ELSE '[R]' END)")}, '*', '[T]') AS template,
    array_to_string(list_transform(
      list_filter(range(1, least(len(st), len(rt)) + 1), lambda i: st[i] <> rt[i] AND NOT list_contains(tw, lower(st[i]))),
      lambda i: (CASE WHEN lower(st[i]) = '*' AND lower(rt[i]) <> '*' THEN lower(tw0) ELSE lower(st[i]) END) || '/' ||
                (CASE WHEN lower(st[i]) <> '*' AND lower(rt[i]) = '*' THEN lower(tw1) ELSE lower(rt[i]) END)), ';') AS grp_refs,
    array_to_string(list_transform(
      list_filter(range(1, least(len(st), len(rt)) + 1), lambda i: st[i] <> rt[i] AND NOT list_contains(tw, lower(st[i]))),
      lambda i: (CASE WHEN lower(st[i]) <> '*' AND lower(rt[i]) = '*' THEN lower(tw1) ELSE lower(rt[i]) END) || '/' ||
                (CASE WHEN lower(st[i]) = '*' AND lower(rt[i]) <> '*' THEN lower(tw0) ELSE lower(st[i]) END)), ';') AS grp_refs_rev,
    list_transform(
      list_filter(range(1, least(len(st), len(rt)) + 1), lambda i: st[i] <> rt[i] AND NOT list_contains(tw, lower(st[i]))),
      lambda i: {{'l': CASE WHEN lower(st[i]) = '*' AND lower(rt[i]) <> '*' THEN lower(tw0) ELSE lower(st[i]) END,
                 'r': CASE WHEN lower(st[i]) <> '*' AND lower(rt[i]) = '*' THEN lower(tw1) ELSE lower(rt[i]) END}}) AS refs
  FROM templ_s
)"""


def swapped_cte(words: dict[str, str], src: str = "pairs", name: str = "swapped") -> str:
    """Reference words of the rewrite swapped: word by word, a final mark and a capital stay."""
    cases = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in words.items())
    bare = "regexp_replace(w, '[.,!?;:]+$', '')"
    new = f"(CASE lower({bare}) {cases} END)"
    cap = f"(CASE WHEN {bare} = upper(substr({bare}, 1, 1)) || lower(substr({bare}, 2)) THEN upper(substr({new}, 1, 1)) || substr({new}, 2) ELSE {new} END)"
    word = f"(CASE WHEN {new} IS NULL THEN w ELSE {cap} || substr(w, length({bare}) + 1) END)"
    return f"""
{name} AS (SELECT * REPLACE (array_to_string(list_transform(string_split(alt_sentence, ' '), lambda w: {word}), ' ') AS alt_sentence) FROM {src})"""
