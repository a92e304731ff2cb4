"""The same queries as SQL for DuckDB, written on their own from the tables.

Parsers are checked against the values their text was made from, not against another parse.
"""

from __future__ import annotations

from runscope.formats import CYCLES, MPKI_COUNTERS

_SENTENCES = """
sentences AS (
  SELECT run_id, idx, length(s) AS n FROM (
    SELECT doc_id AS run_id, unnest(string_split(text, '.')) AS s,
           generate_subscripts(string_split(text, '.'), 1) - 1 AS idx
    FROM documents)
)"""

# counter -> value of sample idx of a sentence with n characters
_VALUES = {
    CYCLES: "(idx + 1) * 100000000",
    "l1_htlb_miss": "(idx + 1) * 64 + n % 64",
    "l2_htlb_miss": "(idx + 1) * 32 + n % 32",
    "l1_tlb_miss": "(idx + 1) * 128 + n * 7 % 128",
    "l2_tlb_miss": "(idx + 1) * 16 + n % 16",
    "click": "(idx + 1) * 8 + n % 8",
}


def _union_samples(values: dict[str, str], where: str = "TRUE", shift: int = 0) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT run_id, CAST(idx - {shift} AS BIGINT) AS sample_idx,"
        f" CAST((idx + 1) * 100000000 AS BIGINT) AS cycles, '{name}' AS counter,"
        f" CAST({value} AS BIGINT) AS value FROM sentences WHERE {where}"
        for name, value in values.items()
    )


_SAMPLES = f"{_SENTENCES}, samples AS ({_union_samples(_VALUES, 'idx >= 6', 6)})"

_TOKENS = """
tokens AS (
  SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY idx, k) - 1 AS BIGINT) AS pos,
         name, CAST(value AS DOUBLE) AS value
  FROM (
    SELECT run_id, idx, 0 AS k,
           CASE n % 5 WHEN 0 THEN 'instructions' WHEN 1 THEN 'error' WHEN 2 THEN 'click'
                      WHEN 3 THEN 'view' ELSE 'l1' END AS name,
           CASE WHEN n % 5 = 0 THEN n % 20 * 1000 ELSE n * 13 % 1000 END AS value
    FROM sentences
    UNION ALL
    SELECT run_id, idx, 1, 'view', n FROM sentences WHERE n % 7 = 0)
)"""

_METRICS = f"""
{_SAMPLES}, {_TOKENS},
log_metrics AS (SELECT run_id, name, arg_max(value, pos) AS value FROM tokens GROUP BY run_id, name),
finals AS (
  SELECT run_id, counter AS name, arg_max(value, sample_idx) AS value,
         arg_max(cycles, sample_idx) / 1e9 AS seconds
  FROM samples GROUP BY run_id, counter),
merged AS (
  SELECT coalesce(l.run_id, r.run_id) AS run_id, coalesce(l.name, r.name) AS name,
         coalesce(CAST(r.value AS DOUBLE), l.value) AS value,
         CASE WHEN r.name IS NULL THEN 'left' ELSE 'right' END AS src,
         CASE WHEN r.name IS NOT NULL THEN l.value END AS overridden
  FROM log_metrics l FULL OUTER JOIN finals r ON l.run_id = r.run_id AND l.name = r.name),
instructions AS (SELECT run_id, value AS instructions FROM log_metrics WHERE name = 'instructions')"""


def _ratio(count: str, total: str) -> str:
    return f"CASE WHEN {total} <> 0 THEN CAST({count} AS DOUBLE) / ({total} / 1000.0::DOUBLE) END"


_MPKI = f"""
mpki AS (
  SELECT m.run_id, {", ".join(
      _ratio(f"max(CASE WHEN m.name = '{c}_miss' THEN m.value END)", "max(i.instructions)") + f" AS {c}_mpki"
      for c in MPKI_COUNTERS)}
  FROM merged m LEFT JOIN instructions i ON m.run_id = i.run_id GROUP BY m.run_id)"""

_WIDE_NAMES = {
    **{n: n for n in ("instructions", "error", "click", "view", "l1")},
    **{f"{c}_miss": f"{c}_miss" for c in MPKI_COUNTERS},
    CYCLES: "cycles",
}
_RESULTS = f"""
{_METRICS}, {_MPKI},
wide AS (
  SELECT run_id, {", ".join(f"max(CASE WHEN name = '{n}' THEN value END) AS {a}" for n, a in _WIDE_NAMES.items())}
  FROM merged GROUP BY run_id),
results AS (
  SELECT wide.*, {", ".join(f"{c}_mpki" for c in MPKI_COUNTERS)}, cycles / 1e9 AS sim_seconds
  FROM wide JOIN mpki USING (run_id))"""

_PLACES = """
places AS (
  SELECT doc_id AS run_id, source AS series, lang AS name, concat_ws('.', lang, 'libc', 'r0', source) AS config
  FROM documents)"""

_DELTAS = f"""
{_METRICS},
stepped AS (
  SELECT s.run_id, sample_idx, cycles / 1e9 AS seconds, counter, value, instructions,
         lag(value) OVER (PARTITION BY s.run_id, counter ORDER BY sample_idx) AS previous
  FROM samples s LEFT JOIN instructions i ON s.run_id = i.run_id),
deltas AS (
  SELECT run_id, sample_idx, seconds, counter,
         CASE WHEN counter = '{CYCLES}' THEN CAST(value AS DOUBLE)
              ELSE CAST(coalesce(value - previous, 0) AS DOUBLE) END AS delta
  FROM stepped
  UNION ALL
  SELECT run_id, sample_idx, seconds, concat('mpki_', replace(counter, '_miss', '')),
         CASE WHEN previous IS NULL THEN {_ratio("value", "instructions")} * 0.0
              ELSE {_ratio("value", "instructions")} - {_ratio("previous", "instructions")} END
  FROM stepped WHERE counter IN ({", ".join(f"'{c}_miss'" for c in MPKI_COUNTERS)}))"""

_LINES = """
lines AS (
  SELECT user_id AS run_id, event_id AS line_no,
         CASE event_type WHEN 'signup' THEN 'INSTRUCTIONS' ELSE concat(upper(event_type), '_X') END AS token,
         CAST(replace(replace(props, '{"k": ', ''), '}', '') AS DOUBLE) AS value
  FROM events)"""

_MANIFEST = """
manifest AS (
  SELECT o_orderkey AS run_id, concat('bench', o_custkey % 5) AS benchmark,
    CASE o_orderkey % 4 WHEN 0 THEN 'libc' WHEN 1 THEN 'stub' WHEN 2 THEN 'localize' ELSE 'handles' END AS runtime,
    concat('r', o_orderkey % 3) AS run_config, concat('cfg', o_custkey % 7) AS fpga,
    CASE WHEN o_orderkey % 11 = 0 THEN concat('bad name/', o_orderkey) WHEN o_orderkey % 13 = 0 THEN ''
         ELSE concat('run-', o_orderkey, '_', substr(o_orderpriority, 1, 1)) END AS run_name,
    CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 9 = 1 THEN ''
         ELSE concat('echo ', o_orderpriority) END AS cmd,
    o_orderdate AS written_at
  FROM orders)"""

_HUE = "concat_ws('.', benchmark, runtime, run_config, fpga)"

_JOBS = """
jobs AS (
  SELECT o_orderkey AS run_id,
         CASE WHEN o_orderkey % 7 IN (0, 1) THEN CAST(-1 AS BIGINT) ELSE o_custkey END AS job_id
  FROM orders)"""

_COMPLETE = """
complete AS (
  SELECT config_id, driver AND bitstream AND image AS complete,
         concat_ws(',', CASE WHEN NOT driver THEN 'driver' END, CASE WHEN NOT bitstream THEN 'bitstream' END,
                   CASE WHEN NOT image THEN 'image' END) AS failed
  FROM (
    SELECT l_orderkey AS config_id,
      bool_or(l_linenumber <= 2 AND l_quantity > 5 AND l_returnflag <> 'R' AND l_linestatus = 'O') AS driver,
      bool_or(l_linenumber IN (3, 4) AND l_returnflag <> 'R') AS bitstream,
      bool_or(l_linenumber IN (5, 6) AND l_quantity > 5 AND l_returnflag <> 'R' AND l_tax > 0.02) AS image
    FROM lineitem GROUP BY l_orderkey))"""

_TIMING = """
timing AS (
  SELECT user_id AS run_id, min(ts) AS started_at, max(ts) AS ended_at FROM events GROUP BY user_id)"""

_ENRICHED = f"""
{_RESULTS}, {_TIMING},
enriched AS (
  SELECT r.*, (epoch_us(ended_at) - epoch_us(started_at)) / 1e6 AS host_walltime,
    d.lang AS name, concat('echo ', d.doc_id) AS command,
    concat_ws('.', d.lang, 'libc', 'r0', d.source) AS config, concat('/work/', d.source) AS dir,
    md5(d.text) AS artifact_md5, strftime(started_at, '%Y-%m-%d-%H%M%S') AS date, ended_at AS "timestamp",
    coalesce(regexp_replace(b.text, '^\\s+|\\s+$', '', 'g'), 'Unk.') AS bitstream_info
  FROM results r LEFT JOIN timing t ON r.run_id = t.run_id
  LEFT JOIN documents d ON r.run_id = d.doc_id
  LEFT JOIN benchmark b ON d.doc_id % 250 = b.item_id)"""

# the text form's cells that are no number, and the header name that holds a comma
_FILE_VALUES = {
    **{k: v for k, v in _VALUES.items() if k not in ("l2_tlb_miss", "click")},
    "l2_tlb_miss": f"CASE WHEN n % 97 <> 0 THEN {_VALUES['l2_tlb_miss']} END",
    "click, all": _VALUES["click"],
}

_FILE_DELTAS = f"""
{_SENTENCES}, samples AS ({_union_samples(_FILE_VALUES, 'idx >= 6', 6)}),
stepped AS (
  SELECT *, last_value(value IGNORE NULLS) OVER (
    PARTITION BY run_id, counter ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous
  FROM samples)"""

_COVERED = f"""
{_MANIFEST},
programs AS (SELECT DISTINCT benchmark AS program, run_config, fpga FROM manifest),
covered AS (
  SELECT g.*, (SELECT count(*) FROM manifest m WHERE m.benchmark = g.program AND m.run_config = g.run_config
    AND m.fpga = g.fpga AND m.runtime = g.runtime AND regexp_full_match(m.run_name, '[a-zA-Z0-9.\\-_]+')) AS runs
  FROM (SELECT * FROM programs CROSS JOIN (VALUES ('libc'), ('stub'), ('localize'), ('handles')) AS r(runtime)) g)"""

_SHOWN = {
    "Finished: ": "name",
    "Benchmark: ": "string_split(config, '.')[1]",
    "Runtime config: ": "string_split(config, '.')[2]",
    "Run config: ": "string_split(config, '.')[3]",
    "FPGA config: ": "string_split(config, '.')[4]",
    "Host walltime (s): ": "CAST(round(CAST(host_walltime AS DECIMAL(20,6)), 2) AS DECIMAL(20,2))",
    "Simulated walltime (s): ": "CAST(round(CAST(sim_seconds AS DECIMAL(20,6)), 2) AS DECIMAL(20,2))",
    "Date: ": "date",
    "Directory: ": "dir",
    "Command: ": "command",
}

ORACLES: dict[str, str] = {
    "uart_scan": f"WITH {_SENTENCES}, {_TOKENS} SELECT run_id, pos, name, value FROM tokens",
    "counter_scan": f"WITH {_SENTENCES} {_union_samples(_FILE_VALUES)}",
    "description_scan": """
        SELECT doc_id AS config_id,
               CASE WHEN doc_id % 5 = 0 THEN 'Unk.' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS description
        FROM documents""",
    "artifact_md5": "SELECT doc_id AS artifact_id, md5(text) AS md5 FROM documents",
    "run_catalog": f"""
        WITH {_MANIFEST}
        SELECT concat('logs/', run_name, strftime(written_at, '%Y-%m-%d%H%M%S'), '/uartlog') AS path, run_name,
               written_at AS stamped_at, run_id AS length, written_at AS modified_at
        FROM manifest WHERE regexp_full_match(run_name, '[a-zA-Z0-9.\\-_]+')""",
    "submission_parse": f"WITH {_JOBS} SELECT run_id, job_id FROM jobs",
    "results_sink": f"""
        WITH {_RESULTS}, {_PLACES}
        SELECT r.* REPLACE (CASE WHEN series = 'src1' THEN -1.0::DOUBLE ELSE click END AS click),
               series, name, config
        FROM results r JOIN places p ON r.run_id = p.run_id""",
    "raw_series_sink": f"""
        WITH {_SAMPLES}, {_PLACES}
        SELECT s.run_id, sample_idx, cycles, counter, value, cycles / 1e9 AS seconds, series, name, config
        FROM samples s JOIN places p ON s.run_id = p.run_id""",
    "delta_series_sink": f"""
        WITH {_DELTAS}, {_PLACES}
        SELECT s.run_id, sample_idx, seconds, counter, delta, series, name, config
        FROM deltas s JOIN places p ON s.run_id = p.run_id""",
    "hue_split": f"""
        WITH {_MANIFEST}
        SELECT run_id, string_split({_HUE}, '.')[1] AS benchmark, string_split({_HUE}, '.')[2] AS runtime_config,
               string_split({_HUE}, '.')[3] AS run_name, string_split({_HUE}, '.')[4] AS fpga_config
        FROM manifest""",
    "hue_compose": f"WITH {_MANIFEST} SELECT run_id, {_HUE} AS hue FROM manifest",
    "metric_name": f"""
        WITH {_LINES}
        SELECT run_id, line_no, lower(split_part(token, '_', 1)) AS name, lower(token) AS full_name, value
        FROM lines""",
    "cycles_to_seconds": f"""
        WITH {_SENTENCES}
        SELECT run_id, CAST(idx - 6 AS BIGINT) AS sample_idx, (idx + 1) * 100000000 / 1e9 AS seconds
        FROM sentences WHERE idx >= 6""",
    "mpki_final": f"WITH {_METRICS}, {_MPKI} SELECT * FROM mpki",
    "mpki_series": f"""
        WITH {_METRICS}
        SELECT s.run_id, sample_idx, concat('mpki_', replace(counter, '_miss', '')) AS counter,
               {_ratio("value", "instructions")} AS mpki
        FROM samples s LEFT JOIN instructions i ON s.run_id = i.run_id
        WHERE counter IN ({", ".join(f"'{c}_miss'" for c in MPKI_COUNTERS)})""",
    "host_walltime": """
        SELECT user_id AS run_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS host_walltime
        FROM events GROUP BY user_id""",
    "run_stamp": f"""
        WITH {_MANIFEST}
        SELECT run_id, strftime(written_at, '%Y-%m-%d%H%M%S') AS run_stamp,
               strftime(written_at, '%Y-%m-%d-%H%M%S') AS report_stamp, strftime(written_at, '%Y%m%d') AS day_stamp,
               written_at AS run_parsed, written_at AS report_parsed,
               CAST(CAST(written_at AS DATE) AS TIMESTAMP) AS day_parsed
        FROM manifest""",
    "command_text": f"""
        WITH {_MANIFEST}
        SELECT run_id, nullif(cmd, '') AS scalar, nullif(cmd, '') AS spaced,
               nullif(replace(cmd, ' ', ' ; '), '') AS chained, nullif(replace(cmd, ' ', chr(10)), '') AS script
        FROM manifest""",
    "job_kind": f"""
        WITH {_MANIFEST}
        SELECT run_id, coalesce(cmd, '') = '' AS interactive,
               CASE WHEN coalesce(cmd, '') = '' THEN concat(run_name, '-interactive') ELSE run_name END AS job_name
        FROM manifest""",
    "result_path": f"""
        WITH {_MANIFEST}, {_JOBS}
        SELECT m.run_id, concat('results/', fpga, '/', benchmark, '/', {_HUE}, '/') AS result_dir,
               concat('out/jobs/', job_id, '.log') AS log
        FROM manifest m JOIN jobs j ON m.run_id = j.run_id""",
    "run_summary": f"""
        WITH {_ENRICHED}
        SELECT run_id, concat_ws(chr(10), {", ".join(
            f"concat('{head}', coalesce(CAST({value} AS VARCHAR), '-'))" for head, value in _SHOWN.items())}) AS text
        FROM enriched""",
    "run_name_valid": f"""
        WITH {_MANIFEST}
        SELECT run_id, run_name, regexp_full_match(run_name, '[a-zA-Z0-9.\\-_]+') AS valid FROM manifest""",
    "warmup_drop": f"WITH {_SAMPLES} SELECT * FROM samples",
    "config_complete": f"WITH {_COMPLETE} SELECT * FROM complete",
    "batch_eligible": f"""
        WITH {_MANIFEST}, {_COMPLETE}
        SELECT m.*, run_id AS config_id FROM manifest m
        WHERE cmd <> '' AND EXISTS (SELECT 1 FROM complete c WHERE c.config_id = m.run_id AND c.complete)""",
    "cycle_window": f"""
        WITH {_SAMPLES}
        SELECT * FROM samples
        WHERE (run_id % 3 = 0 OR cycles >= run_id % 10 * 200000000)
          AND (run_id % 4 = 0 OR cycles <= 1500000000 + run_id % 7 * 100000000)""",
    "roi_slice": """
        WITH first_start AS (
          SELECT *, min(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id) AS s FROM events),
        first_end AS (
          SELECT *, min(CASE WHEN event_type = 'purchase' AND event_id > s THEN event_id END)
                    OVER (PARTITION BY user_id) AS e FROM first_start)
        SELECT user_id AS run_id, event_id, event_type, value FROM first_end
        WHERE event_id >= s AND (e IS NULL OR event_id <= e)""",
    "metric_merge": f"WITH {_METRICS} SELECT * FROM merged",
    "config_overlay": f"""
        WITH {_MANIFEST}
        SELECT m.* REPLACE (
                 CASE WHEN run_id % 3 = 0 THEN 'cli' ELSE runtime END AS runtime,
                 CASE WHEN run_id % 5 = 0 THEN '' ELSE cmd END AS cmd),
               run_id % 4 <> 0 AS dry_run, CASE WHEN run_id % 6 = 0 THEN 0 ELSE 2 END AS verbosity,
               concat_ws(',', CASE WHEN run_id % 7 = 0 THEN 'partition_flag' END,
                         CASE WHEN run_id % 2 = 0 THEN 'nodelist_flag' END) AS ignored
        FROM manifest m""",
    "run_enrich": f"WITH {_ENRICHED} SELECT * FROM enriched",
    "sweep_grid": f"""
        WITH {_MANIFEST}, programs AS (SELECT DISTINCT benchmark AS program, run_config, fpga FROM manifest)
        SELECT program, run_config, fpga, runtime, concat_ws('.', program, runtime, run_config, fpga) AS label
        FROM programs CROSS JOIN (VALUES ('libc'), ('stub'), ('localize'), ('handles')) AS r(runtime)""",
    "counter_final": f"WITH {_METRICS} SELECT * FROM finals",
    "uart_last_wins": f"""
        WITH {_LINES}
        SELECT run_id, lower(split_part(token, '_', 1)) AS name, arg_max(value, line_no) AS value
        FROM lines GROUP BY 1, 2""",
    "results_pivot": f"WITH {_RESULTS} SELECT * FROM results",
    "trace_histogram": """
        SELECT run_id, key, CAST(count(*) AS BIGINT) AS n,
               CAST(row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, key) AS BIGINT) AS rank
        FROM (SELECT doc_id AS run_id, unnest(string_split(text, ' ')) AS key FROM documents)
        GROUP BY run_id, key""",
    "counter_delta": f"""
        WITH {_DELTAS}
        SELECT d.run_id, d.sample_idx, d.counter, s.value, d.seconds, d.delta
        FROM deltas d JOIN samples s
          ON d.run_id = s.run_id AND d.sample_idx = s.sample_idx AND d.counter = s.counter""",
    "latest_pointer": f"""
        WITH {_MANIFEST}
        SELECT * FROM manifest WHERE run_id IN (
          SELECT arg_max(run_id, (written_at, run_id)) FROM manifest GROUP BY fpga, benchmark, runtime)""",
    "latest_merge": f"""
        WITH {_MANIFEST}
        SELECT * FROM manifest WHERE run_id IN (
          SELECT arg_max(run_id, (written_at, run_id)) FROM manifest GROUP BY fpga, benchmark, runtime)""",
    "latest_pointer_global": f"""
        WITH {_MANIFEST} SELECT * FROM manifest ORDER BY written_at DESC, run_id DESC LIMIT 1""",
    "config_menu": f"""
        WITH {_MANIFEST}
        SELECT concat(run_name, '.bit') AS name, written_at AS mtime,
               row_number() OVER (ORDER BY written_at DESC, concat(run_name, '.bit')) AS rank
        FROM manifest WHERE regexp_matches(concat(run_name, '.bit'), '.bit')""",
    "run_id_assign": "SELECT o_orderkey AS run_key, TRUE AS well_formed, TRUE AS \"unique\", TRUE AS stable FROM orders",
    "plot_series": f"""
        WITH {_DELTAS} SELECT run_id, counter, seconds, delta FROM deltas WHERE counter <> '{CYCLES}'""",
    "counter_files": f"WITH {_SENTENCES} {_union_samples(_FILE_VALUES)}",
    "counter_records": f"WITH {_SENTENCES} {_union_samples(_FILE_VALUES)}",
    "counter_file_deltas": f"""
        WITH {_FILE_DELTAS}
        SELECT run_id, sample_idx, counter, value, cycles / 1e9 AS seconds,
               CASE WHEN counter = '{CYCLES}' OR value IS NULL THEN CAST(value AS DOUBLE)
                    ELSE CAST(coalesce(value - previous, 0) AS DOUBLE) END AS delta
        FROM stepped""",
    "artifact_files": """
        SELECT doc_id AS run_id, CAST(octet_length(encode(concat(text, chr(10)))) AS BIGINT) AS length, md5(concat(text, chr(10))) AS md5
        FROM documents UNION ALL SELECT -1, 0, 'd41d8cd98f00b204e9800998ecf8427e'""",
    "counter_rejects": f"""
        WITH {_SENTENCES}
        SELECT run_id, CAST(idx AS BIGINT) AS sample_idx, 'l2_tlb_miss' AS counter, 'n/a' AS cell, 'number' AS reason
        FROM sentences WHERE n % 97 = 0""",
    "results_every": f"""
        WITH {_METRICS}
        SELECT run_id, count(*) AS n_metrics, string_agg(name, '|' ORDER BY name) AS names, sum(value) AS total,
               max(CASE WHEN name = 'instructions' THEN value END) AS instructions,
               max(CASE WHEN name = '{CYCLES}' THEN value END) AS cycles
        FROM merged GROUP BY run_id""",
    "sweep_coverage": f"WITH {_COVERED} SELECT * FROM covered",
    "sweep_gaps": f"""
        WITH {_COVERED}
        {" UNION ALL ".join(f"SELECT '{a}' AS axis, {a} AS value, count(*) AS expected, count(*) FILTER (runs = 0) AS missing, CAST(sum(runs) AS BIGINT) AS runs FROM covered GROUP BY {a}" for a in ("program", "run_config", "fpga", "runtime"))}
        UNION ALL SELECT NULL, NULL, count(*), count(*) FILTER (runs = 0), CAST(coalesce(sum(runs), 0) AS BIGINT) FROM covered""",
    "log_files": f"WITH {_METRICS} SELECT run_id, name, value FROM log_metrics",
    "mpki_report": f"WITH {_METRICS}, {_MPKI} SELECT * FROM mpki",
}

ORACLES |= {"stored_delta": ORACLES["counter_delta"], "stored_final": ORACLES["counter_final"]}
