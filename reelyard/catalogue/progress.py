"""Queries over progress events and job states."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..operators import progress as ops
from ..session import materialize
from ..sources.adapters import sql_fixed, sql_over, table, view
from . import register

TERMINAL = "status IN ('completed', 'failed', 'cancelled')"


def events(spark, sf_dir):
    return view(spark, sf_dir, "progress_events")


def stored_events(spark, sf_dir):
    """The event table written once, for operators that scan their input more than once."""
    return materialize(events(spark, sf_dir), "progress-events")


@register(
    "a1_overall_progress",
    sql_over(
        ["file_progress"],
        f"""
WITH g AS (
  SELECT batch_id, count(*) FILTER (status = 'completed') AS completed_files, count(*) AS total_files,
    sum(CASE WHEN status = 'completed' THEN 1000 ELSE CAST(floor(least(99.0e0, greatest(0.0e0, CAST(progress AS DOUBLE))) * 10 + 0.5e0) AS BIGINT) END) AS tenths,
    coalesce(sum(greatest(0, original_size)) FILTER (status = 'completed' AND original_size IS NOT NULL AND output_size IS NOT NULL), 0) AS o,
    coalesce(sum(greatest(0, output_size)) FILTER (status = 'completed' AND original_size IS NOT NULL AND output_size IS NOT NULL), 0) AS p
  FROM file_progress GROUP BY batch_id)
SELECT batch_id, completed_files, total_files,
  {sql_fixed('(CAST(tenths AS DOUBLE) / 10 / total_files)', 1)} AS progress,
  CAST(o AS BIGINT) AS original_bytes, CAST(p AS BIGINT) AS output_bytes, CAST(o - p AS BIGINT) AS saved_bytes
FROM g""",
    ),
)
def overall_progress(spark, sf_dir):
    return ops.overall_progress(view(spark, sf_dir, "file_progress"))


@register(
    "w1_latest_events",
    sql_over(
        ["progress_events"],
        """SELECT job_id, event_id, sequence, status, progress_tenths, elapsed_cs FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY sequence DESC) AS rn FROM progress_events) WHERE rn = 1""",
    ),
)
def latest_events(spark, sf_dir):
    return ops.latest_events(events(spark, sf_dir)).select(
        "job_id", "event_id", "sequence", "status", "progress_tenths", "elapsed_cs"
    )


REPLAY_FILTER = """
, c AS ({cursor_sql}),
p AS (SELECT e.* FROM e JOIN c USING (job_id) WHERE e.sequence > c.after),
s AS (SELECT job_id, min(sequence) AS stop FROM p WHERE status IN ('completed', 'failed', 'cancelled') GROUP BY job_id)
SELECT p.job_id, p.sequence, p.status FROM p LEFT JOIN s USING (job_id) WHERE s.stop IS NULL OR p.sequence <= s.stop"""


@register(
    "w2_replay",
    sql_over(
        ["progress_events"],
        "WITH e AS (SELECT job_id, sequence, status FROM progress_events)"
        + REPLAY_FILTER.format(
            cursor_sql="SELECT DISTINCT job_id, CASE WHEN job_id % 3 = 2 THEN 0 ELSE job_id % 17 END AS after FROM e"
        ),
    ),
)
def replay(spark, sf_dir):
    rows = stored_events(spark, sf_dir)
    job = F.col("job_id")
    cursor = F.when(job % 3 == 0, F.concat_ws(":", job, job % 17)).when(
        job % 3 == 1, F.concat(F.lit(" "), job, F.lit(":"), job % 17, F.lit(" "))
    ).otherwise(F.lit("no-number"))
    cursors = rows.select("job_id").distinct().select("job_id", cursor.alias("last_event_id"))
    return ops.replay(rows, cursors).select("job_id", "sequence", "status")


@register(
    "w2_replay_conversations",
    sql_over(
        ["replay_events"],
        """SELECT job_id, sequence, stage, n_chars FROM replay_events WHERE sequence > job_id % 4""",
    ),
)
def replay_conversations(spark, sf_dir):
    rows = view(spark, sf_dir, "replay_events").withColumn("status", F.lit("processing"))
    cursors = rows.select("job_id").distinct().select(
        "job_id", F.concat_ws(":", "job_id", F.col("job_id") % 4).alias("last_event_id")
    )
    return ops.replay(rows, cursors).select("job_id", "sequence", "stage", F.col("n_chars").cast("bigint").alias("n_chars"))


NORMAL_SQL = """
ends AS (SELECT job_id, min(sequence) AS stop FROM progress_events WHERE status IN ('completed', 'failed', 'cancelled') GROUP BY job_id),
normal AS (
  SELECT e.job_id, e.sequence, e.ts, e.status, e.elapsed_cs, CASE WHEN status = 'completed' THEN 1000 ELSE
    max(least(990, greatest(0, progress_tenths))) OVER (PARTITION BY e.job_id ORDER BY sequence) END AS progress
  FROM progress_events e LEFT JOIN ends USING (job_id) WHERE stop IS NULL OR sequence <= stop)"""


@register(
    "w3_normalize_progress",
    sql_over(
        ["progress_events"],
        f"WITH {NORMAL_SQL.strip()} SELECT job_id, sequence, status, CAST(progress AS BIGINT) AS progress FROM normal",
    ),
)
def normalize_progress(spark, sf_dir):
    return ops.normalize_progress(stored_events(spark, sf_dir)).select(
        "job_id", "sequence", "status", "progress"
    )


@register(
    "x6_late_event_tally",
    sql_over(
        ["progress_events"],
        """WITH t AS (SELECT job_id, min(sequence) AS stop FROM progress_events WHERE status IN ('completed', 'failed', 'cancelled') GROUP BY job_id)
SELECT job_id, count(*) AS late_events FROM progress_events JOIN t USING (job_id) WHERE sequence > stop GROUP BY job_id""",
    ),
)
def late_event_tally(spark, sf_dir):
    late = ops.late_events(stored_events(spark, sf_dir))
    return late.groupBy("job_id").agg(F.count(F.lit(1)).alias("late_events"))


REMAINING_SQL = f"""WITH {NORMAL_SQL.strip()},
n AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY sequence) AS i, sequence, status,
        CAST(progress AS DOUBLE) / 10 AS p, CAST(elapsed_cs AS DOUBLE) / 100 AS t FROM normal),
fold AS (
  SELECT job_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS sequence, '' AS status, CAST(NULL AS DOUBLE) AS lp, CAST(NULL AS DOUBLE) AS lt,
    CAST([] AS DOUBLE[]) AS r, CAST(NULL AS DOUBLE) AS s, CAST(NULL AS BIGINT) AS shown
  FROM n WHERE i = 1
  UNION ALL
  SELECT job_id, i, sequence, status, lp, lt, r, s,
    CASE WHEN status = 'completed' THEN 0
         WHEN NOT valid THEN shown
         WHEN NOT counts THEN coalesce(CASE WHEN s IS NOT NULL THEN CAST(greatest(0, floor(s + 0.5e0)) AS BIGINT) END, shown)
         WHEN ready THEN CAST(greatest(0, floor(s + 0.5e0)) AS BIGINT)
         ELSE shown END
  FROM (
    SELECT job_id, i, sequence, status, valid, counts, ready, shown, r,
      CASE WHEN counts THEN p ELSE lp END AS lp, CASE WHEN counts THEN t ELSE lt END AS lt,
      CASE WHEN ready THEN CASE WHEN s IS NULL THEN avg_r ELSE s * 0.65e0 + avg_r * 0.35e0 END ELSE s END AS s
    FROM (
      SELECT *, counts AND len(r) >= 3 AND p >= 1 AND t >= 2 AS ready,
        (coalesce(r[1], 0) * 1 + coalesce(r[2], 0) * 2 + coalesce(r[3], 0) * 3 + coalesce(r[4], 0) * 4
         + coalesce(r[5], 0) * 5 + coalesce(r[6], 0) * 6 + coalesce(r[7], 0) * 7 + coalesce(r[8], 0) * 8)
          / (CAST(len(r) * (len(r) + 1) AS DOUBLE) / 2) AS avg_r
      FROM (
        SELECT n.job_id, n.i, n.sequence, n.status, n.p, n.t, f.lp, f.lt, f.s, f.shown, v.valid, v.valid AND (f.lp IS NULL OR (n.p > f.lp AND n.t > f.lt)) AS counts,
          CASE WHEN v.valid AND (f.lp IS NULL OR (n.p > f.lp AND n.t > f.lt))
               THEN list_slice(list_append(f.r, n.t / n.p * (100.0e0 - n.p)), CASE WHEN len(f.r) = 8 THEN 2 ELSE 1 END, 9) ELSE f.r END AS r
        FROM fold f JOIN (SELECT *, p > 0 AND p < 100 AND t > 0 AS valid FROM n) v ON v.job_id = f.job_id AND v.i = f.i + 1
        JOIN n ON n.job_id = v.job_id AND n.i = v.i))))
SELECT job_id, sequence, shown AS remaining_s FROM fold WHERE i > 0"""


@register("w4_remaining_time", sql_over(["progress_events"], REMAINING_SQL))
def remaining_time(spark, sf_dir):
    normal = materialize(ops.normalize_progress(stored_events(spark, sf_dir)), "normal-progress")
    return ops.remaining_time(normal).select("job_id", "sequence", "remaining_s")


@register(
    "w9_cap_events",
    sql_over(
        ["progress_events"],
        """SELECT job_id, event_id, sequence FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY sequence DESC) AS rn FROM progress_events) WHERE rn <= 400""",
    ),
)
def cap_events(spark, sf_dir):
    return ops.cap_events(events(spark, sf_dir)).select("job_id", "event_id", "sequence")


@register(
    "w9_cap_log_lines",
    sql_over(
        ["progress_events"],
        """WITH d AS (SELECT job_id, status || '-' || CAST(progress_tenths AS VARCHAR) AS log_id, min(sequence) AS position FROM progress_events GROUP BY ALL)
SELECT job_id, log_id, position FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY position DESC) AS rn FROM d) WHERE rn <= 80""",
    ),
)
def cap_log_lines(spark, sf_dir):
    lines = events(spark, sf_dir).select(
        "job_id",
        F.concat_ws("-", "status", "progress_tenths").alias("log_id"),
        F.col("sequence").alias("position"),
    )
    return ops.cap_log_lines(lines)


@register(
    "j12_illegal_transitions",
    sql_over(
        ["progress_events"],
        f"""WITH edges(f, t) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, bs in dims.ALLOWED_TRANSITIONS.items() for b in bs)}),
l AS (SELECT job_id, sequence, status AS to_status, lag(status) OVER (PARTITION BY job_id ORDER BY sequence) AS from_status FROM progress_events)
SELECT job_id, sequence, from_status, to_status FROM l
WHERE from_status <> to_status AND NOT EXISTS (SELECT 1 FROM edges WHERE f = from_status AND t = to_status)""",
    ),
)
def illegal_transitions(spark, sf_dir):
    return ops.illegal_transitions(stored_events(spark, sf_dir), dims.transition_edges(spark)).select(
        "job_id", "sequence", "from_status", "to_status"
    )


@register(
    "w13_log_feed",
    sql_over(
        ["progress_events"],
        """WITH a AS (SELECT job_id, event_id, sequence, status, event_id * 8 + ((event_id * 7919) % 5) * 400 AS arrival FROM progress_events),
m AS (SELECT *, max(sequence) OVER (PARTITION BY job_id ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a)
SELECT job_id, event_id, sequence, CASE status WHEN 'failed' THEN 'error' WHEN 'cancelled' THEN 'warning' WHEN 'completed' THEN 'success' ELSE 'info' END AS level
FROM m WHERE seen IS NULL OR sequence > seen""",
    ),
)
def log_feed(spark, sf_dir):
    # Arrivals out of order: events are held back by up to 1600 places.
    event = F.col("event_id")
    arrived = stored_events(spark, sf_dir).select(
        "job_id", "event_id", "sequence", "status",
        (event * 8 + (event * 7919) % 5 * 400 ).alias("arrival"),
    )
    return ops.log_feed(arrived).select("job_id", "event_id", "sequence", "level")


def staged_events(spark, sf_dir):
    """Normalised events with a stage index implied by progress."""
    normal = ops.normalize_progress(stored_events(spark, sf_dir))
    return normal.withColumn("stage_index", ops.stage_index_of(F.col("progress") / 10, 9))


TIMELINE_LABELS = tuple(f"stage-{i}" for i in range(9))


@register(
    "w11_stage_timeline",
    sql_over(
        ["progress_events"],
        f"""WITH {NORMAL_SQL.strip()},
e AS (SELECT *, CAST(least(8, floor(least(99.0e0, CAST(progress AS DOUBLE) / 10) / 100 * 9)) AS INTEGER) AS a FROM normal),
l AS (SELECT CAST(unnest(generate_series(0, 8)) AS INTEGER) AS i),
m AS (SELECT job_id, i, max(CASE WHEN a < i AND status <> 'completed' THEN sequence END) AS reset,
    max(CASE WHEN a <= i AND status <> 'completed' AND NOT (a = i AND status IN ('failed', 'cancelled')) THEN sequence END) AS open,
    arg_max(a, sequence) AS fa, arg_max(status, sequence) AS fs, arg_max(ts, sequence) AS ft
  FROM e, l GROUP BY job_id, i),
s AS (SELECT m.job_id, m.i, any_value(fa) AS fa, any_value(fs) AS fs, any_value(ft) AS ft,
    arg_min(CASE WHEN (a > m.i OR status = 'completed' OR (a = m.i AND status NOT IN ('pending', 'queued'))) AND (reset IS NULL OR sequence > reset) THEN ts END,
            CASE WHEN (a > m.i OR status = 'completed' OR (a = m.i AND status NOT IN ('pending', 'queued'))) AND (reset IS NULL OR sequence > reset) THEN sequence END) AS started,
    arg_min(CASE WHEN (a > m.i OR status = 'completed' OR (a = m.i AND status IN ('failed', 'cancelled'))) AND (open IS NULL OR sequence > open) THEN ts END,
            CASE WHEN (a > m.i OR status = 'completed' OR (a = m.i AND status IN ('failed', 'cancelled'))) AND (open IS NULL OR sequence > open) THEN sequence END) AS done
  FROM m JOIN e ON e.job_id = m.job_id GROUP BY m.job_id, m.i),
r AS (SELECT *, CASE WHEN fs = 'completed' OR fa > i THEN 'completed' WHEN fa < i THEN 'pending' WHEN fs IN ('failed', 'cancelled') THEN fs
    WHEN fs IN ('pending', 'queued') THEN 'pending' ELSE 'processing' END AS stage_status FROM s)
SELECT job_id, i AS stage_index, stage_status,
  strftime(CASE WHEN fa < i AND fs <> 'completed' THEN NULL ELSE started END, '%Y-%m-%d %H:%M:%S') AS started_at,
  strftime(CASE WHEN stage_status = 'completed' THEN done WHEN stage_status IN ('failed', 'cancelled') THEN ft END, '%Y-%m-%d %H:%M:%S') AS completed_at
FROM r""",
    ),
)
def stage_timeline(spark, sf_dir):
    def text(name):
        return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)

    return ops.stage_timeline(staged_events(spark, sf_dir), TIMELINE_LABELS).select(
        "job_id", "stage_index", "stage_status", text("started_at"), text("completed_at")
    )


# Stage texts for the inference check: labels, pattern-only texts and unknown texts.
STAGE_TEXTS = (
    "ファイルを確認", "ffprobeで動画情報を解析", "動画をエンコード中", "音声を結合", "検証中",
    "サムネイル", "デコード待ち", "設定を読込", "プレビュー生成", "待機",
)


def _label_case(labels, column="stage"):
    hits = " ".join(
        f"WHEN contains({column}, '{label}') OR contains('{label}', {column}) THEN {i}"
        for i, label in enumerate(labels)
    )
    return f"CASE {hits} END"


def _pattern_case(last, column="stage"):
    hits = " ".join(
        f"WHEN regexp_matches({column}, '{p}') THEN {min(i, last)}"
        for i, p in enumerate(dims.STAGE_PATTERNS)
    )
    return f"CASE {hits} END"


@register(
    "w12_infer_stage",
    sql_over(
        ["progress_events"],
        f"""WITH e AS (SELECT job_id, sequence, CAST(progress_tenths AS DOUBLE) / 10 AS progress,
    CASE (event_id * 31 + sequence) % 10 {' '.join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(STAGE_TEXTS))} END AS stage FROM progress_events),
x AS (SELECT *, {_label_case(dims.STAGE_LABELS['video'])} AS exact, {_pattern_case(8)} AS pat FROM e),
f AS (
  SELECT job_id, CAST(0 AS BIGINT) AS sequence, 0 AS idx FROM (SELECT DISTINCT job_id FROM x)
  UNION ALL
  SELECT x.job_id, x.sequence, CASE WHEN exact IS NOT NULL THEN exact WHEN pat IS NOT NULL THEN least(8, greatest(f.idx, pat))
    WHEN progress >= 99 THEN 8 ELSE least(8, greatest(0, f.idx)) END
  FROM f JOIN x ON x.job_id = f.job_id AND x.sequence = f.sequence + 1)
SELECT job_id, sequence, CAST(idx AS INTEGER) AS stage_index FROM f WHERE sequence > 0""",
    ),
)
def infer_stage(spark, sf_dir):
    texts = F.array(*[F.lit(t) for t in STAGE_TEXTS])
    pick = ((F.col("event_id") * 31 + F.col("sequence")) % 10 + 1).cast("int")
    rows = stored_events(spark, sf_dir).select(
        "job_id", "sequence", (F.col("progress_tenths") / 10).alias("progress"),
        F.element_at(texts, pick).alias("stage"),
    )
    return ops.infer_stage(rows, dims.STAGE_LABELS["video"]).select(
        "job_id", "sequence", "stage_index"
    )


@register(
    "s3_explode_job_state",
    sql_over(
        ["progress_events"],
        """WITH c AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY sequence DESC) AS rn FROM progress_events),
k AS (SELECT * FROM c WHERE rn <= 400 AND event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0 AND job_id % 10 <> 9)
SELECT job_id, sequence, status, CAST(progress_tenths AS DOUBLE) / 10 AS progress FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY sequence DESC) AS r2 FROM k) WHERE r2 <= 400""",
    ),
)
def explode_job_state(spark, sf_dir):
    """Job documents as a job writes them: at most 400 events each, some of them invalid."""
    kept = ops.cap_events(events(spark, sf_dir))
    event = F.col("event_id")
    entry = F.struct(
        F.when(event % 11 == 0, F.lit("another-job")).otherwise(F.col("job_id").cast("string")).alias("jobId"),
        F.when(event % 13 == 0, F.lit("not-a-number")).otherwise(F.col("sequence").cast("string")).alias("sequence"),
        "status",
        (F.col("progress_tenths") / 10).alias("progress"),
        (F.col("elapsed_cs") / 100).alias("elapsedSeconds"),
        F.when(event % 17 != 0, F.array(F.struct(F.lit("step-1").alias("id")))).alias("steps"),
    )
    document = F.to_json(
        F.struct(
            F.when(F.col("job_id") % 10 == 9, 2).otherwise(1).alias("version"),
            F.struct(F.col("job_id").cast("string").alias("jobId")).alias("state"),
            F.col("events"),
        )
    )
    documents = (
        kept.groupBy("job_id")
        .agg(F.collect_list(entry).alias("events"))
        .select(F.col("job_id").cast("string").alias("job_id"), document.alias("document"))
    )
    return ops.explode_job_state(documents).select(
        F.col("job_id").cast("bigint").alias("job_id"), "sequence", "status", "progress"
    )


@register(
    "j11_recover_jobs",
    sql_over(
        ["progress_events"],
        """WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY sequence DESC) AS rn FROM progress_events) WHERE rn = 1),
a AS (SELECT c_custkey AS job_id, 'item-' || CAST(c_custkey AS VARCHAR) AS item_id, CASE c_custkey % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'video' ELSE 'audio' END AS kind FROM customer)
SELECT a.job_id, item_id, kind,
  CASE WHEN l.status IS NULL OR l.status IN ('completed', 'failed', 'cancelled') THEN 'forget' ELSE 'resume' END AS action,
  CASE WHEN l.status IS NULL THEN 'missing' WHEN l.status IN ('completed', 'failed', 'cancelled') THEN 'terminal' ELSE 'active' END AS reason,
  CASE WHEN l.status = 'completed' THEN 'complete' WHEN l.status = 'failed' THEN 'error' WHEN l.status = 'cancelled' THEN 'cancelled'
    WHEN l.status IN ('pending', 'queued') THEN 'queued' WHEN l.status IS NOT NULL THEN 'processing' END AS item_status,
  CAST(coalesce(progress_tenths, 0) AS DOUBLE) / 10 AS progress, coalesce(sequence, 0) AS sequence,
  coalesce(CAST(elapsed_cs AS DOUBLE) / 100, 0.0e0) AS elapsed_s, CASE WHEN kind <> 'image' THEN a.job_id END AS upload_id
FROM a LEFT JOIN l ON l.job_id = a.job_id""",
    ),
)
def recover_jobs(spark, sf_dir):
    key = F.col("c_custkey")
    active = table(spark, sf_dir, "customer").select(
        key.alias("job_id"),
        F.concat(F.lit("item-"), key).alias("item_id"),
        F.when(key % 3 == 0, "image").when(key % 3 == 1, "video").otherwise("audio").alias("kind"),
    )
    return ops.recover_jobs(active, ops.latest_events(events(spark, sf_dir)))


@register(
    "j13_assemble_results",
    sql_over(
        ["media_files", "encode_attempts", "progress_events"],
        f"""WITH b AS (SELECT file_id, min(output_bytes) AS output_size FROM encode_attempts GROUP BY file_id),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY sequence DESC) AS rn FROM progress_events) WHERE rn = 1),
m AS (SELECT m.file_id AS job_id, m.kind, m.size_bytes, b.output_size, 'out-' || CAST(m.file_id AS VARCHAR) || CASE WHEN m.file_id % 9 = 0 THEN '' ELSE '.M-P4' END AS output_name,
    CASE m.file_id % 4 WHEN 1 THEN 'clip.' || CAST(m.file_id AS VARCHAR) || '.mov' WHEN 2 THEN 'con.jpg' WHEN 3 THEN 'a<' || CAST(m.file_id AS VARCHAR) || '>. .jpg' END AS original_name
  FROM media_files m JOIN b USING (file_id)),
j AS (SELECT m.*, l.job_id IS NOT NULL AS live, l.elapsed_cs FROM m LEFT JOIN l ON l.job_id = m.job_id),
k AS (SELECT *, coalesce(original_name, output_name) AS file_name, CASE WHEN live THEN size_bytes ELSE output_size END AS o FROM j)
SELECT job_id, CASE WHEN live THEN kind ELSE 'image' END AS kind, file_name,
  CASE job_id % 4 WHEN 1 THEN 'clip.' || CAST(job_id AS VARCHAR) WHEN 2 THEN '_con' WHEN 3 THEN 'a_' || CAST(job_id AS VARCHAR) || '_' ELSE 'out-' || CAST(job_id AS VARCHAR) END
    || CASE WHEN job_id % 9 = 0 THEN '_comp.bin' ELSE '_comp.mp4' END AS download_name,
  CASE WHEN live AND job_id % 2 = 0 THEN 'webm' WHEN job_id % 9 = 0 THEN '' ELSE 'm-p4' END AS output_format,
  o AS original_size, output_size, o - output_size AS saved_bytes,
  CASE WHEN o > 0 THEN {sql_fixed('(CAST(o - output_size AS DOUBLE) / CAST(o AS DOUBLE) * 100)', 1)} END AS reduction_percent,
  CASE WHEN live THEN CAST(elapsed_cs AS DOUBLE) / 100 END AS elapsed_s
FROM k""",
    ),
)
def assemble_results(spark, sf_dir):
    best = view(spark, sf_dir, "encode_attempts").groupBy("file_id").agg(
        F.min("output_bytes").alias("output_size")
    )
    file_id = F.col("file_id")
    files = view(spark, sf_dir, "media_files")
    manifests = files.join(best, "file_id").select(
        file_id.alias("job_id"),
        F.concat(F.lit("out-"), file_id, F.when(file_id % 9 == 0, "").otherwise(".M-P4")).alias("output_name"),
        F.when(file_id % 4 == 1, F.concat(F.lit("clip."), file_id, F.lit(".mov"))).when(file_id % 4 == 2, "con.jpg")
        .when(file_id % 4 == 3, F.concat(F.lit("a<"), file_id, F.lit(">. .jpg"))).alias("original_name"),
        F.lit(None).cast("string").alias("download_name"),
        "output_size",
    )
    details = files.select(
        file_id.alias("job_id"), "kind", F.col("size_bytes").alias("original_size"),
        F.when(file_id % 2 == 0, "webm").alias("output_format"),
    )
    latest = (
        ops.latest_events(events(spark, sf_dir))
        .join(details, "job_id")
        .select(
            "job_id", F.lit(None).cast("string").alias("file_name"), "kind", "original_size",
            "output_format", (F.col("elapsed_cs") / 100).alias("elapsed_s"),
        )
    )
    return ops.assemble_results(manifests, latest)


@register(
    "w8_history",
    sql_over(
        ["media_files"],
        """WITH e AS (SELECT batch_id AS job_id, file_id AS entry_id, kind, size_bytes, created_at FROM media_files),
n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, entry_id DESC) AS rn FROM e)
SELECT job_id, entry_id, kind, size_bytes FROM n WHERE rn = 1 ORDER BY created_at DESC, entry_id DESC LIMIT 60""",
    ),
)
def history(spark, sf_dir):
    entries = view(spark, sf_dir, "media_files").select(
        F.col("batch_id").alias("job_id"), F.col("file_id").alias("entry_id"), "kind",
        "size_bytes", "created_at",
    )
    return ops.history(entries).select("job_id", "entry_id", "kind", "size_bytes")
