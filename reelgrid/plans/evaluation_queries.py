"""Evaluation questions from transcripts, and the measures of a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.functions.text import nfc
from reelgrid.operators import evaluate, ranking, temporal
from reelgrid.plans.etl_queries import CLIPS
from reelgrid.plans.search_queries import FRAMES, HIT_FRAMES, POINTS, SPEECH, _dedupe_sql, _hits_sql, dense_hits, frames_of, shots_of, speech_of, with_frames
from reelgrid.session import kept

_TOKENS = "list_filter(regexp_extract_all(lower(nfc_normalize({t})), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: length(x) <= 24)"


def _docs(spark, d):
    return speech_of(spark, d).where("text_corrected is not null").select("video_id", "segment", "start_sec", nfc("text_corrected").alias("t"), "asr_persons")


def _idf(spark, d):
    docs = _docs(spark, d)
    total = docs.agg(F.count("*").alias("n"))
    df = evaluate.document_frequency(docs, "t").crossJoin(F.broadcast(total))  # one row on the right
    return evaluate.rarity(df, F.col("n"))


def document_frequency(spark, d):
    return evaluate.document_frequency(_docs(spark, d), "t")


def distinctiveness(spark, d):
    s = evaluate.distinctiveness(_docs(spark, d), ["video_id", "segment"], "t", "asr_persons", _idf(spark, d))
    return s.select("video_id", "segment", F.round("distinctiveness", 5).alias("distinctiveness"))


def best_window(spark, d):
    return evaluate.best_window(_docs(spark, d), ["video_id", "segment"], "t", _idf(spark, d), 12)


def _shot_docs(spark, d):
    """Every shot with the speech inside it, the persons named there and its start; written once."""
    c = shots_of(spark, d).select("video_id", "shot_id", F.col("start_sec").alias("lo"), F.col("end_sec").alias("hi"))
    keys = ["video_id", "shot_id"]
    said = temporal.texts_in_window(c, speech_of(spark, d).where("text_corrected is not null"), keys, ("lo", "hi"), "text_corrected")
    named = temporal.entities_in_window(c, speech_of(spark, d), keys, ("lo", "hi"), "asr_persons")
    docs = said.join(named, keys).join(c.select(*keys, F.col("lo").alias("start_sec")), keys)
    return kept(docs.where("trim(joined) <> ''").select(*keys, "start_sec", nfc("joined").alias("t"), "entities"))


def eval_set(spark, d):
    """Questions from the speech of shots that have enough words and some keyframes, not too many."""
    docs, keys = _shot_docs(spark, d), ["video_id", "shot_id"]
    df = evaluate.document_frequency(docs, "t").crossJoin(F.broadcast(docs.agg(F.count("*").alias("n"))))  # one row on the right
    idf = kept(evaluate.rarity(df, F.col("n")))
    fit = kept(evaluate.askable(docs, frames_of(spark, d), "t"))
    score = evaluate.distinctiveness(fit, keys, "t", "entities", idf)
    c = evaluate.best_window(fit, keys, "t", idf).join(score, keys).join(fit.select(*keys, "start_sec", "frames"), keys)
    made = evaluate.one_per_question(c.withColumn("distinctiveness", F.round("distinctiveness", 5)), per_video=3, limit=300)
    listed = lambda x: F.concat_ws(",", F.col(x).cast("array<string>"))
    return made.select("best_text", "video_id", listed("answers").alias("answers"), listed("answer_frames").alias("answer_frames"), "start_sec", "distinctiveness")


def shot_frames(spark, d):
    f = evaluate.shot_frames(frames_of(spark, d).where("shot_id is not null and original_frame_id is not null"))
    return f.select("video_id", "shot_id", F.concat_ws(",", F.col("frames").cast("array<string>")).alias("frames"))


def _run(spark, d):
    """(the ranked hits, the answers, the query ids) of one search: the shots of a query's three nearest points count as right."""
    h = kept(with_frames(spark, d, dense_hits(spark, d, 100)))
    answers = h.where("rank <= 3").select("query_id", "video_id", "shot_id").distinct()
    return ranking.dedupe_by_shot(h, 20), answers, h.select("query_id").distinct()


def rank_of(spark, d):
    return evaluate.rank_of(*_run(spark, d))


def recall_mrr(spark, d):
    s = evaluate.summarise(rank_of(spark, d))
    return s.select(*[F.round(c, 8).alias(c) if c not in ("queries", "found") else F.col(c) for c in s.columns])


def remap_answers(spark, d):
    """The frames of every ten keyframes of a video, moved to the shots by their times."""
    f = frames_of(spark, d).where("original_frame_id is not null")
    asked = F.concat_ws("-", "video_id", F.floor((F.col("keyframe_n") - 1) / 10).cast("string"))
    a = f.groupBy("video_id", asked.alias("query_id")).agg(F.collect_set("original_frame_id").alias("answer_frame_ids"))
    c = shots_of(spark, d).where("start_sec is not null and end_sec is not null")
    m = evaluate.remap_answers(a, f.select("video_id", F.col("original_frame_id").alias("frame_id"), "pts_sec"), c)
    return m.select("query_id", F.concat_ws(",", F.col("answer_shot_ids").cast("array<string>")).alias("shots"), "lost")


def ndcg(spark, d):
    hits, answers, q = _run(spark, d)
    return evaluate.ndcg(hits, answers.withColumn("gain", F.lit(1.0)), q).select("query_id", F.round("ndcg", 6).alias("ndcg"))


QUERIES = {f.__name__: f for f in (document_frequency, distinctiveness, best_window, eval_set, shot_frames, rank_of, recall_mrr, remap_answers, ndcg)}

_DOCS = "dc as (select video_id, segment, start_sec, nfc_normalize(text_corrected) as t, asr_persons from s where text_corrected is not null)"
_IDF = f"""dt as (select distinct video_id, segment, unnest({_TOKENS.format(t='t')}) as token from dc), fq as (select token, count(*) as df from dt group by all),
idf as (select token, ln((select count(*) from dc) / (1 + df)) as idf from fq where df >= 3)"""
_SCORE = f"""en as (select video_id, segment, unnest({_TOKENS.format(t='n')}) as token from (select video_id, segment, unnest(asr_persons) as n from dc) where n is not null),
ts as (select dt.video_id, dt.segment, idf.idf * case when exists (select 1 from en where en.video_id = dt.video_id and en.segment = dt.segment and en.token = dt.token) then 2 else 1 end as x from dt join idf using (token)),
ds as (select video_id, segment, sum(x) as distinctiveness from (select *, row_number() over (partition by video_id, segment order by x desc) as r from ts) where r <= 8 group by all)"""
_WINDOW = f"""wd as (select video_id, segment, t, string_split(trim(regexp_replace(t, '\\s+', ' ', 'g')), ' ') as l from dc), we as (select video_id, segment, unnest(l) as word, generate_subscripts(l, 1) as p from wd where len(l) > 12),
wt as (select distinct video_id, segment, p, unnest({_TOKENS.format(t='word')}) as token from we), ws as (select video_id, segment, p, sum(idf) as x from wt join idf using (token) group by all),
wr as (select we.video_id, we.segment, we.p, round(sum(coalesce(x, 0)) over w, 9) as total, count(*) over w as n, string_agg(word, ' ') over w as span from we left join ws using (video_id, segment, p) window w as (partition by we.video_id, we.segment order by we.p rows between current row and 11 following)),
wb as (select video_id, segment, span as best_text from (select *, row_number() over (partition by video_id, segment order by total desc, p) as r from wr where n = 12) where r = 1 union all select video_id, segment, t from wd where len(l) <= 12)"""
_RANKS = f"""kv as ({_dedupe_sql('hf', 'video_id, shot_id', 20)}), an as (select distinct query_id, video_id, shot_id from hf where rank <= 3),
rk as (select q.query_id, (select min(rank) from kv where kv.query_id = q.query_id and exists (select 1 from an where an.query_id = kv.query_id and an.video_id = kv.video_id and an.shot_id = kv.shot_id)) as rank from (select distinct query_id from h) q)"""


def _w(*parts: str) -> str:
    return "with " + ",\n".join(parts) + " "


_H100 = _hits_sql(100)
SQL = {
    "document_frequency": _w(SPEECH, _DOCS, _IDF) + "select token, df from fq",
    "distinctiveness": _w(SPEECH, _DOCS, _IDF, _SCORE) + "select video_id, segment, round(distinctiveness, 5) as distinctiveness from ds",
    "best_window": _w(SPEECH, _DOCS, _IDF, _WINDOW) + "select * from wb",
    "eval_set": _w(SPEECH, CLIPS, FRAMES) + f""", j as (select c.video_id, c.shot_id, c.start_sec as lo, s.start_sec as a, s.segment, s.text_corrected as x, s.asr_persons as l from c join s on s.video_id = c.video_id and s.end_sec >= s.start_sec and c.end_sec >= c.start_sec and s.start_sec < c.end_sec and s.end_sec > c.start_sec),
dc as (select video_id, shot_id, any_value(lo) as start_sec, nfc_normalize(string_agg(x, ' ' order by a, segment)) as t from j where x is not null group by video_id, shot_id having trim(string_agg(x, ' ' order by a, segment)) <> ''),
dt as (select distinct video_id, shot_id, unnest({_TOKENS.format(t='t')}) as token from dc), fq as (select token, count(*) as df from dt group by all), idf as (select token, ln((select count(*) from dc) / (1 + df)) as idf from fq where df >= 3),
kf as (select video_id, shot_id, count(original_frame_id) as n, list(original_frame_id order by original_frame_id) filter (original_frame_id is not null) as frames from f group by all),
ft as (select dc.*, kf.frames from dc join kf using (video_id, shot_id) where kf.n between 1 and 30 and len({_TOKENS.format(t='t')}) >= 6),
en as (select distinct video_id, shot_id, unnest({_TOKENS.format(t='n')}) as token from (select video_id, shot_id, unnest(l) as n from j) where n is not null),
ts as (select dt.video_id, dt.shot_id, idf.idf * case when en.token is not null then 2 else 1 end as x from dt join idf using (token) left join en on en.video_id = dt.video_id and en.shot_id = dt.shot_id and en.token = dt.token),
ds as (select video_id, shot_id, sum(x) as distinctiveness from (select *, row_number() over (partition by video_id, shot_id order by x desc) as r from ts) where r <= 8 group by all),
wd as (select video_id, shot_id, t, string_split(trim(regexp_replace(t, '\\s+', ' ', 'g')), ' ') as l from ft), we as (select video_id, shot_id, len(l) as n, l, unnest(l) as word, generate_subscripts(l, 1) as p from wd where len(l) > 32),
wt as (select distinct video_id, shot_id, p, unnest({_TOKENS.format(t='word')}) as token from we), ws as (select video_id, shot_id, p, sum(idf) as x from wt join idf using (token) group by all),
wr as (select we.*, round(sum(coalesce(x, 0)) over (partition by we.video_id, we.shot_id order by we.p rows between current row and 31 following), 9) as total from we left join ws using (video_id, shot_id, p)),
wb as (select video_id, shot_id, array_to_string(l[p : p + 31], ' ') as best_text from (select *, row_number() over (partition by video_id, shot_id order by total desc, p) as r from wr where p + 31 <= n) where r = 1 union all select video_id, shot_id, t from wd where len(l) <= 32),
c2 as (select wb.*, round(ds.distinctiveness, 5) as x, ft.start_sec, ft.frames from wb join ds using (video_id, shot_id) join ft using (video_id, shot_id)),
g as (select best_text, min(video_id) as video_id, string_agg(distinct shot_id, ',' order by shot_id) as answers, array_to_string(list_sort(list_distinct(flatten(list(frames)))), ',') as answer_frames, min(start_sec) as start_sec, max(x) as distinctiveness from c2 group by best_text having count(distinct video_id) = 1),
r as (select *, row_number() over (partition by video_id order by round(distinctiveness, 6) desc, best_text) as r from g) select best_text, video_id, answers, answer_frames, start_sec, distinctiveness from r where r <= 3 order by round(distinctiveness, 6) desc, best_text limit 300""",
    "shot_frames": _w(FRAMES) + "select video_id, shot_id, string_agg(original_frame_id, ',' order by original_frame_id) as frames from f where shot_id is not null and original_frame_id is not null group by all",
    "remap_answers": _w(FRAMES, CLIPS) + """, a as (select distinct video_id, video_id || '-' || (keyframe_n - 1) // 10 as q, original_frame_id as fr from f where original_frame_id is not null), t as (select video_id, original_frame_id as fr, min(pts_sec) as mid from f where original_frame_id is not null group by all), m as (select a.video_id, a.q, a.fr, t.mid from a left join t using (video_id, fr)),
cs as (select *, row_number() over (w) as pos, lead(shot_id) over (w) as ni, lead(start_sec) over (w) as ns, lead(end_sec) over (w) as ne from c where start_sec is not null and end_sec is not null window w as (partition by video_id order by start_sec, end_sec, shot_id)),
j as (select m.video_id, m.q, m.fr, m.mid, cs.* exclude (video_id), row_number() over (partition by m.video_id, m.q, m.fr order by pos desc nulls last) as r from m left join cs on cs.video_id = m.video_id and cs.start_sec <= m.mid),
x as (select j.q, case when mid is null then null when j.shot_id is null then o.shot_id when mid <= end_sec then j.shot_id when least(abs(mid - ns), abs(mid - ne)) < least(abs(mid - start_sec), abs(mid - end_sec)) then ni else j.shot_id end as s from j left join (select video_id, shot_id from cs where pos = 1) o on o.video_id = j.video_id where r = 1)
select q as query_id, coalesce(array_to_string(list_sort(list(distinct s) filter (s is not null)), ','), '') as shots, cast(sum(case when s is null then 1 else 0 end) as bigint) as lost from x group by all""",
    "ndcg": _w(POINTS, FRAMES, _hits_sql(100), HIT_FRAMES, _RANKS) + """, g as (select q.query_id, coalesce((select sum(1 / log2(rank + 1)) from kv where kv.query_id = q.query_id and exists (select 1 from an where an.query_id = kv.query_id and an.video_id = kv.video_id and an.shot_id = kv.shot_id)), 0) as dcg,
  (select count(*) from an where an.query_id = q.query_id) as n from (select distinct query_id from h) q) select query_id, round(dcg / list_sum(list_transform(range(1, n + 1), lambda i: 1 / log2(i + 1))), 6) as ndcg from g""",
    "rank_of": _w(POINTS, FRAMES, _H100, HIT_FRAMES, _RANKS) + "select * from rk",
    "recall_mrr": _w(POINTS, FRAMES, _H100, HIT_FRAMES, _RANKS) + """, m as (select count(*) as queries, count(rank) as found, coalesce(avg(case when rank <= 1 then 1.0 else 0 end), 0) as r1, coalesce(avg(case when rank <= 5 then 1.0 else 0 end), 0) as r5, coalesce(avg(case when rank <= 20 then 1.0 else 0 end), 0) as r20, coalesce(avg(case when rank <= 50 then 1.0 else 0 end), 0) as r50, coalesce(avg(case when rank <= 100 then 1.0 else 0 end), 0) as r100, coalesce(avg(coalesce(1.0 / rank, 0)), 0) as mrr from rk)
select queries, found, round(r1, 8) as recall_at_1, round(r5, 8) as recall_at_5, round(r20, 8) as recall_at_20, round(r50, 8) as recall_at_50, round(r100, 8) as recall_at_100, round(mrr, 8) as mrr, round((r1 + r5 + r20 + r50 + r100) / 5, 8) as mean_recall from m""",
}
