"""Text functions, story scores, scorecard, scenes and captions over the document table."""

from __future__ import annotations

from pyspark.sql import functions as F

from castwise import params as P
from castwise.catalog.base import half_up, query, table, view
from castwise.catalog.selections import CHAPTERS, SIGNALS, _hits, _strip
from castwise.functions import clock, passes, scores, text
from castwise.plans import documentary, performance, timeline

BEATS = {"setup": ("the ", "elle", "ich"), "conflict": ("but", "ung"), "turn": ("then", "tion"), "lesson": ("us", "que")}
EMOTION = ("her", "that", "and", "der", "elle", "con")
PHRASES = ("the of", "and the", "que la", "in der", "la de")
STOP = ("that", "thth", "with", "from", "elle", "nicht", "para", "this")


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _docs(spark, folder):
    return table(spark, folder, "documents")


@query("text_profile", r"""
    select doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) as normal, len(regexp_extract_all(text, '\S+')) as words,
           round(greatest(1, len(regexp_extract_all(text, '\S+'))) / 155.0::double * 60.0::double, 2) as seconds,
           left(text, 500) || case when length(text) > 500 then '…' else '' end as summary
    from documents
""")
def text_profile(spark, folder):
    told = passes.normal_and_words(F.col("text"))
    return _docs(spark, folder).select(
        "doc_id", told["normal"].alias("normal"), told["words"].alias("words"),
        text.reading_seconds(told["words"]).alias("seconds"), text.summary(F.col("text")).alias("summary"))


@query("short_labels", r"""
    with w as (select doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as ws from documents)
    select doc_id,
      array_to_string(ws[1:8], ' ') || case when len(ws) > 8 then '…' else '' end as overlay,
      replace(upper(array_to_string(ws[1:6], ' ')), 'ẞ', 'SS') as headline,
      case when length(text) <= 90 then text else regexp_replace(left(text, 89), '\s+$', '') || '…' end as fitted,
      coalesce(nullif(array_to_string(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: length(x) > 4)[1:6], ', '), ''),
               'abstract concept') as hint,
      array_to_string(list_transform(regexp_extract_all(lower(array_to_string(ws, ' ')), '\p{L}+|\P{L}+'),
        lambda r: replace(upper(left(r, 1)), 'ẞ', 'SS') || substr(r, 2)), '') as titled
    from w
""")
def short_labels(spark, folder):
    body = F.col("text")
    return _docs(spark, folder).select(
        "doc_id", text.overlay(body).alias("overlay"), text.headline(body).alias("headline"),
        text.fit(body, 90).alias("fitted"), passes.visual_hint(body).alias("hint"),
        passes.title_case(F.trim(F.regexp_replace(body, r"\s+", " "))).alias("titled"))


@query("keywords", r"""
    with r as (select doc_id, list_concat(regexp_extract_all(lower(text), '[A-Za-z]{4,}'),
                 [lang, 'documentary', 'education', 'facts', 'explained', 'story']) as l from documents),
    u as (select doc_id, unnest(l) as w, unnest(range(0, len(l))) as i from r),
    f as (select doc_id, w, min(i) as i from u group by 1, 2)
    select doc_id, string_agg(w, ' ' order by i) as keywords from f group by 1
""")
def keywords(spark, folder):
    base = F.array(F.col("lang"), *[F.lit(w) for w in P.KEYWORD_BASE])
    return _docs(spark, folder).select(
        "doc_id", F.array_join(passes.keywords(F.col("text"), base), " ").alias("keywords"))


@query("search_phrase", rf"""
    with r as (select doc_id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]{{3,}}'), lambda w: lower(w)),
                 lambda w: not list_contains({_list(STOP)}, w)) as l from documents),
    u as (select doc_id, unnest(l) as w, unnest(range(0, len(l))) as i from r),
    f as (select doc_id, w, min(i) as i from u group by 1, 2),
    k as (select *, row_number() over (partition by doc_id order by i) as rn from f)
    select d.doc_id, coalesce(string_agg(w, ' ' order by i), '') as phrase from documents d left join k on k.doc_id = d.doc_id and rn <= 4 group by 1
""")
def search_phrase(spark, folder):
    return _docs(spark, folder).select("doc_id", passes.search_phrase(F.col("text"), STOP).alias("phrase"))


# the prose has no section markers, so a sectioned reply is built from it
_HOOKS = "(select conv_id, {0}(text, turn) as hook from conversations group by conv_id)"
_REPLY_SQL = """case when doc_id % 5 = 0 then text else '[HOOK] ' || coalesce(hook, lang) || chr(10) || '[INTRODUCTION]' || coalesce(source, '')
  || ' [note] ' || lang || chr(10) || chr(10) || chr(10) || chr(10) || '[BODY] ' || text || ' [CTA]' ||
  case when doc_id % 3 = 0 then '' else ' follow' end || ' [HOOK] last ' || doc_id end"""


def _replies(spark, folder):
    hooks = table(spark, folder, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.min_by("text", "turn").alias("hook"))
    return _docs(spark, folder).join(hooks, "doc_id", "left").select(F.col("doc_id").alias("id"), F.expr(_REPLY_SQL.replace("chr(10)", "'\\n'")).alias("reply"))


def _section(name: str) -> str:
    return f"coalesce(list_filter(p, lambda x: x.k = '{name}')[-1].v, '')"


def _dropped(x: str) -> str:
    for phrase in PHRASES:
        x = f"regexp_replace({x}, '{phrase}', '', 'gi')"
    return _strip(rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')")


_SECTIONS = rf"""
    with r as (select doc_id as id, {_REPLY_SQL} as reply from documents left join {_HOOKS.format('arg_min')} on conv_id = doc_id),
    s as (select id, reply, regexp_extract_all(reply, '\[([A-Z]+)\]', 1) as hs, string_split_regex(reply, '\[[A-Z]+\]')[2:] as bs from r),
    z as (
      select id, case when len(hs) > 0 then list_transform(list_zip(hs, bs), lambda t: {{'k': t[1], 'v': {_strip('t[2]')}}})
                 else [{{'k': 'BODY', 'v': {_strip('reply')}}}] end as p from s)
"""


@query("section_parse", _SECTIONS + f"""
    select id, {_section('HOOK')} as hook, {_section('INTRODUCTION')} as introduction, {_section('BODY')} as body, {_section('CTA')} as cta,
           len(list_distinct(list_transform(p, lambda x: x.k)))::integer as sections
    from z
""")
def section_parse(spark, folder):
    found = _replies(spark, folder).withColumn("s", passes.sections(F.col("reply")))
    pick = lambda n: F.coalesce(F.try_element_at("s", F.lit(n)), F.lit("")).alias(n.lower())
    return found.select("id", pick("HOOK"), pick("INTRODUCTION"), pick("BODY"), pick("CTA"), F.size("s").alias("sections"))


@query("script_build", _SECTIONS + f""",
    c as (select id, {_dropped(_section('HOOK'))} as hook, {_dropped(_section('INTRODUCTION'))} as introduction,
            {_dropped(_section('BODY'))} as body, {_dropped(_section('CTA'))} as raw_cta,
            len(list_filter(p, lambda x: x.k = 'CTA')) > 0 as has_cta from z),
    f as (select *, array_to_string(list_filter([hook, introduction, body, raw_cta], lambda x: x <> ''), chr(10) || chr(10)) as full_text from c)
    select id, hook, introduction, case when has_cta then raw_cta else 'Follow.' end as cta, full_text,
           len(regexp_extract_all(full_text, '\\S+')) as word_count from f
""")
def script_build(spark, folder):
    rows = documentary.script_from_reply(_replies(spark, folder), banned=PHRASES, cta="Follow.")
    return rows.select("id", "hook", "introduction", "cta", "full_text", "word_count")


@query("banned_phrases", f"""
    select doc_id, {_dropped("text || chr(10) || chr(10) || chr(10) || chr(10) || replace(upper(text), 'ẞ', 'SS')")} as cleaned from documents
""")
def banned_phrases(spark, folder):
    body = F.concat("text", F.lit("\n\n\n\n"), F.upper("text"))
    return _docs(spark, folder).select("doc_id", passes.drop_phrases(body, PHRASES).alias("cleaned"))


@query("prompt_table", r"""
    select doc_id, 'TASK: script' || chr(10) || 'TOPIC: ' || source || chr(10) || 'CATEGORY: ' || lang || chr(10) || 'Keep {braces} as they are.'
      || chr(10) || text as prompt,
      'TASK: other' || chr(10) || 'TOPIC: ' || source || chr(10) || 'SIZE: ' || n_chars as bare
    from documents
""")
def prompt_table(spark, folder):
    template = "TASK: script\nTOPIC: {topic}\nCATEGORY: {category}\nKeep {braces} as they are.\n{facts}"
    topic = F.col("source")
    return _docs(spark, folder).select(
        "doc_id",
        text.fill_template(template, {"topic": topic, "category": F.col("lang"), "facts": F.col("text")}).alias("prompt"),
        text.marked_prompt("other", {"topic": topic, "size": F.col("n_chars")}).alias("bare"))


def _wording(template: str) -> str:
    """DuckDB text of a fixed sentence with the topic filled in."""
    return "'" + template.replace("'", "''").replace("{topic}", "' || topic || '") + "'"


@query("documentary_script", r"""
    with d as (select doc_id as id, source as topic, case when doc_id % 3 = 0 then '' else 'One decision, ' || lang end as hook,
                 ['Origins', 'The Turning Point', 'The Consequences', 'What It Means Today'][1:cast(doc_id % 4 + 1 as integer)] as names, text, lang from documents),
    e as (select *, case when hook <> '' then hook || chr(10) || chr(10) else '' end || """ + _wording(P.INTRO_TEXT) + r""" as intro,
      """ + _wording(P.ENDING_TEXT) + r""" as ending,
      list_transform(names, lambda n, i: '[CHAPTER: ' || n || ']' || chr(10) || case when i = 1 then text else
        lang || ' ' || lower(n) end) as blocks from d),
    f as (select *, array_to_string(list_concat(list_concat(['[INTRODUCTION]' || chr(10) || intro], blocks),
        ['[CONCLUSION]' || chr(10) || ending, '[CTA]' || chr(10) || 'Follow.']), chr(10) || chr(10)) as full_text from e)
    select id, full_text, len(regexp_extract_all(full_text, '\S+')) as word_count, 'documentary-' || len(names) || '-chapters' as structure from f
""")
def documentary_script(spark, folder):
    names = F.array(*[F.lit(n) for n in ("Origins", "The Turning Point", "The Consequences", "What It Means Today")])
    rows = _docs(spark, folder).select(
        F.col("doc_id").alias("id"), F.col("source").alias("topic"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("One decision, "), "lang")).alias("hook"),
        F.transform(F.slice(names, F.lit(1), (F.col("doc_id") % 4 + 1).cast("int")), lambda n, i: F.struct(
            n.alias("name"),
            F.when(i == 0, F.col("text")).otherwise(F.concat("lang", F.lit(" "), F.lower(n))).alias("body"),
        )).alias("chapters"))
    return documentary.assemble(rows, "Follow.").select("id", "full_text", "word_count", "structure")


@query("documentary_chapters", CHAPTERS + r""",
    t as (select c.id, c.topic, case when coalesce(c.title, '') <> '' then c.title || chr(10) || chr(10) else '' end || """ + _wording(P.INTRO_TEXT) + r""" as intro,
      """ + _wording(P.ENDING_TEXT) + r""" as ending, d.g as names, x.text as first, m.turns from content_v c join d using (subcategory)
      left join documents x on x.doc_id = c.id
      left join (select conv_id, map(list(turn), list(text)) as turns from conversations group by 1) m on m.conv_id = c.id),
    b as (select *, list_transform(names, lambda n, i: '[CHAPTER: ' || n || ']' || chr(10) ||
      coalesce(case when i = 1 then first else turns[i - 2] end, '')) as blocks from t),
    f as (select *, array_to_string(list_concat(list_concat(['[INTRODUCTION]' || chr(10) || intro], blocks),
      ['[CONCLUSION]' || chr(10) || ending, '[CTA]' || chr(10) || 'Follow.']), chr(10) || chr(10)) as full_text from b)
    select id, full_text, len(regexp_extract_all(full_text, '\S+')) as word_count, 'documentary-' || len(names) || '-chapters' as structure from f
""", ["content_v"])
def documentary_chapters(spark, folder):
    """Chapters derived per brand lead the scripts of its items. A document is the first chapter, turns of a conversation the next."""
    rows = view(spark, folder, "content_v").select("id", F.col("subcategory").alias("category"), "topic", F.col("title").alias("hook"))
    first = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.lit(0).alias("chapter_no"), F.col("text").alias("body"))
    turns = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("id"), (F.col("turn") + 1).cast("int").alias("chapter_no"), F.col("text").alias("body"))
    found = documentary.chapters(rows, minimum=9, maximum=9)
    return documentary.scripts(rows, found, first.unionByName(turns), "Follow.").select("id", "full_text", "word_count", "structure")


# ------------------------------------------------------------------ scores

_STORY = rf"""
    with t as (
      select doc_id, text, lower(text) as low, n_chars, source, lang,
             regexp_extract_all(lower(text), '[a-z'']+') as toks,
             list_transform(list_filter(string_split_regex(text, '[.!?]+'), lambda s: {_strip('s')} <> ''),
               lambda s: len(regexp_extract_all(s, '\S+'))) as ls from documents),
    u as (
      select *, ({" + ".join("(" + " or ".join(f"contains(low, '{w}')" for w in ws) + ")::int" for ws in BEATS.values())}) / 4.0::double * 100 as beat,
        least(100.0::double, len(list_filter(toks, lambda w: list_contains({_list(EMOTION)}, w))) / greatest(1, len(toks)) * 4000) as emo,
        case when len(ls) > 2 then least(100.0::double, sqrt((len(ls) * list_sum(list_transform(ls, lambda x: x * x)) - list_sum(ls) * list_sum(ls))::double)
          / len(ls) / greatest(1.0::double, list_sum(ls)::double / len(ls)) * 200) else 40.0 end as variety from t),
    st as (
      select *, case when coalesce(text, '') = '' then 0.0::double else
        round(0.4::decimal(3,2) * beat::decimal(14,6) + 0.25::decimal(3,2) * emo::decimal(14,6) + 0.15::decimal(3,2) * variety::decimal(14,6)
          + 0.2::decimal(3,2) * case when {_strip("split_part(text, chr(10), 1)")} <> '' and contains(text, chr(10))
              and {_strip("split_part(text, chr(10), -1)")} <> '' then 100 else 60 end, 1)::double end as story from u)
"""


def _story():
    """The first line introduces a text, the last one of several ends it."""
    body = F.col("text")
    ending = F.when(F.contains(body, F.lit("\n")), F.substring_index(body, "\n", -1))
    return scores.storytelling(body, scores.structured(F.substring_index(body, "\n", 1), ending), BEATS, EMOTION)


@query("storytelling", _STORY + "select doc_id, story as storytelling from st")
def storytelling(spark, folder):
    return _docs(spark, folder).select("doc_id", _story().alias("storytelling"))


@query("score_bands", """
    select event_id, case when value * 3 < 34 then 'low' when value * 3 < 67 then 'medium' else 'high' end as risk,
           case when value >= 60 then 'worked' else 'failed' end as outcome,
           least(100.0::double, greatest(0.0::double, value * 3 - 5)) as clamped,
           strftime(ts, '%Y-W%W') as week, strftime(ts, '%a') as weekday
    from events
""")
def score_bands(spark, folder):
    v = F.col("value")
    return table(spark, folder, "events").select(
        "event_id", scores.risk_band(v * 3).alias("risk"), scores.outcome(v).alias("outcome"),
        scores.clamp(v * 3 - 5).alias("clamped"), clock.week_label(F.col("ts")).alias("week"),
        F.date_format("ts", "E").alias("weekday"))


@query("latest_report", """
    select o_orderkey as id, 'P' || o_custkey as period from orders order by o_orderdate desc, o_orderkey desc limit 1
""")
def latest_report(spark, folder):
    reports = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("period"),
        F.col("o_orderdate").alias("created_at"))
    return performance.latest_report(reports).select("id", "period")


# ------------------------------------------------------------------ timeline

_SCENES = rf"""
    with p as (select doc_id as run_id, source as title, text, string_split(regexp_replace({_strip(r"regexp_replace(text || ' [BODY] ' || lang || '. End of it!', '\[[A-Z]+\]', ' ', 'g')")},
                 '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as raw from documents),
    f as (select run_id, title, text, list_filter(list_transform(raw, lambda s: {_strip('s')}), lambda s: length(s) > 3) as ss from p),
    e as (select run_id, title, text, unnest(ss) as narration, cast(unnest(range(0, len(ss))) as integer) as idx from f),
    sc as (
      select *, round(greatest(1, len(regexp_extract_all(narration, '\S+'))) / 155.0::double * 60.0::double, 2) as spoken from e),
    plan as (
      select run_id, title, text, narration, idx, least(6.0::double, greatest(2.5::double, spoken)) as duration from sc)
"""


def _script_of():
    return F.concat("text", F.lit(" [BODY] "), "lang", F.lit(". End of it!"))


def _scripts(spark, folder):
    return _docs(spark, folder).select(
        F.col("doc_id").alias("run_id"), F.col("source").alias("title"),
        _script_of().alias("script"),
        text.reading_seconds(passes.word_count(F.col("text"))).alias("narration_seconds"))


def _scenes(spark, folder):
    return timeline.scene_plan(_scripts(spark, folder))


@query("scene_plan", _SCENES + r"""
    select run_id, idx, narration, duration, ['slow-zoom', 'pan-left', 'pan-right', 'fade', 'parallax'][idx % 5 + 1] as animation,
      'cinematic documentary still, muted palette, dramatic lighting, ' || title || ': ' || coalesce(nullif(array_to_string(
        list_filter(regexp_extract_all(narration, '[A-Za-z]+'), lambda x: length(x) > 4)[1:6], ', '), ''), 'abstract concept') as visual_prompt,
      array_to_string(list_filter(string_split_regex(narration, '\s+'), lambda x: x <> '')[1:8], ' ')
        || case when len(list_filter(string_split_regex(narration, '\s+'), lambda x: x <> '')) > 8 then '…' else '' end as text_overlay
    from plan
""")
def scene_plan(spark, folder):
    return _scenes(spark, folder)


@query("plan_totals", _SCENES + """
    select run_id, count(*) as scenes, cast(sum(cast(duration as decimal(18, 2))) as double) as total_duration,
           """ + half_up("cast(sum(cast(duration as decimal(18, 2))) as double) / count(*)", 2) + """ as avg_duration from plan group by 1
""")
def plan_totals(spark, folder):
    return timeline.totals_in_row(timeline.scene_rows(_scripts(spark, folder)))


_RESCALED = _SCENES + r""",
    spoken as (select doc_id as run_id, round(greatest(1, len(regexp_extract_all(text, '\S+'))) / 155.0::double * 60.0::double, 2)
                 as narration_seconds from documents),
    sums as (select run_id, cast(sum(cast(greatest(duration, 0.8) as decimal(18, 2))) as double) as total from plan group by 1),
    tot as (select * from sums join spoken using (run_id)),
    res as (
      select p.run_id, idx, narration, case when abs(total - narration_seconds) > 1.0
        then """ + half_up("greatest(duration, 0.8::double) * (narration_seconds / total)", 2) + r""" else duration end as duration
      from plan p join tot t on t.run_id = p.run_id)
"""


def _rescaled(spark, folder):
    return timeline.rescale_rows(timeline.scene_rows(_scripts(spark, folder)))


@query("scene_rescale", _RESCALED + "select run_id, idx, duration from res")
def scene_rescale(spark, folder):
    return _rescaled(spark, folder).select("run_id", F.explode_outer("scenes").alias("s")).filter(F.col("s").isNotNull()).select("run_id", "s.idx", "s.duration")


_STAMP = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, ({0} // 60000) % 60, ({0} // 1000) % 60, {0} % 1000)"
_CUES = _RESCALED + f""",
    bl as (select run_id, idx, case when idx % 7 = 3 then '' else narration end as said,
             cast(greatest(duration, 0.8) * 1000 + 0.5 as bigint) // 10 * 10 as ms from res),
    tm as (select *, cast(sum(ms) over w as bigint) as stop, cast(sum((said <> '')::int) over w as bigint) as cue
           from bl window w as (partition by run_id order by idx)),
    cu as (select run_id, cue, {_STAMP.format('(stop - ms)')} as start_time, {_STAMP.format('stop')} as end_time, said as caption
           from tm where said <> '')
"""


def _cues(spark, folder):
    gaps = F.transform("scenes", lambda s: F.struct(
        s["idx"].alias("idx"), F.when(s["idx"] % 7 == 3, " ").otherwise(s["narration"]).alias("narration"), s["duration"].alias("duration")))
    return timeline.caption_rows(_rescaled(spark, folder).withColumn("scenes", gaps))


@query("caption_cues", _CUES + "select * from cu")
def caption_cues(spark, folder):
    return _cues(spark, folder).drop("cue_text")


@query("caption_file", _CUES + """
    select run_id, cue, cue || chr(10) || start_time || ' --> ' || end_time || chr(10) || caption || chr(10) as cue_text from cu
""")
def caption_file(spark, folder):
    return _cues(spark, folder).select("run_id", "cue", "cue_text")


@query("scene_images", _SCENES + """,
    pool as (select doc_id as run_id, list_transform(range(0, doc_id % 4), lambda i: 'img-' || doc_id || '-' || i) as images from documents)
    select run_id, idx, case when len(images) > 0 then images[idx % len(images) + 1] end as image from plan left join pool using (run_id)
""")
def scene_images(spark, folder):
    n = (F.col("doc_id") % 4).cast("int")
    pools = _docs(spark, folder).select(F.col("doc_id").alias("run_id"), F.when(n > 0, F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("img-"), F.col("doc_id").cast("string"), F.lit("-"), i.cast("string"))
    )).alias("images"))
    return timeline.assign_images(_scenes(spark, folder), pools).select("run_id", "idx", "image")
