"""The registered queries once more, as DuckDB SQL over the same tables."""

from __future__ import annotations

from voxtally.functions import fixed
from voxtally.plans.tables import DELAYS, FS, ITERATIONS, PHASES, PRIORITY_TAG, SEGMENT_FS, TAGS

# Patterns of the three formats, as an independent check of the splits.
RUN_NAME = r"^(sp|np)_([a-z]+)_(\d+)it(\d+)(HBB|BB|MRI)_([0-9]+(?:\.[0-9]+)?)delay(?:\.out)?$"
NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"
EVENT_LINE = rf"^(Read file|Write file|[^ ]+) ({NUMBER}) ({NUMBER}) ([^ ]+) ([^ ]+) (-?[0-9]+)$"
CHUNK_NAME = r"^(?:inc\d*-)*(.+)_(\d+)_(\d+)_(\d+)\.nii$"
WHITESPACE = (
    r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _pick(values: list[str], at: str) -> str:
    return f"({_list(values)})[(({at}) % {len(values)})::INT + 1]"


def _case(key: str, mapping: dict) -> str:
    whens = " ".join(
        f"WHEN {k if isinstance(k, int) else repr(k)} THEN {repr(v) if isinstance(v, str) else f'{v!r}::DOUBLE'}"
        for k, v in mapping.items()
    )
    return f"CASE {key} {whens} END"


_RUN_FIELDS = f"""
    regexp_extract(run, '{RUN_NAME}', 1) AS engine,
    regexp_extract(run, '{RUN_NAME}', 2) AS fs,
    regexp_extract(run, '{RUN_NAME}', 3)::INT AS iterations,
    regexp_extract(run, '{RUN_NAME}', 4)::INT AS blocks,
    regexp_extract(run, '{RUN_NAME}', 5) AS image,
    regexp_extract(run, '{RUN_NAME}', 6)::DOUBLE AS delay
"""

_TASKS = f"""
te0 AS (
  SELECT event_id, user_id AS executor,
    {_pick(fixed.ENGINES, 'user_id')} || '_' || {_pick(FS, 'user_id // 2')} || '_' ||
    {_pick(ITERATIONS, 'user_id // 40')} || 'it' || {_pick(TAGS, 'user_id // 8')} || '_' ||
    {_pick(DELAYS, 'user_id // 120')} || 'delay.out' AS run,
    {_case('event_type', PHASES)} AS name,
    epoch_us(ts)::DOUBLE / 1e6 AS start,
    epoch_us(ts)::DOUBLE / 1e6 + value AS "end",
    'node' || (user_id % {fixed.NODES})::VARCHAR AS node,
    'img_' || (event_id % 5 * 769)::VARCHAR || '_' || (event_id // 5 % 5 * 603)::VARCHAR || '_' ||
    (event_id // 25 % 5 * 694)::VARCHAR || '.nii' AS chunk
  FROM events),
te AS (
  SELECT event_id, run, name, start, "end", node,
    CASE WHEN name = '{fixed.DRIVER}' THEN '{fixed.ALL_FILES}' ELSE chunk END AS filename, executor
  FROM te0),
ne AS (SELECT te.*, {_RUN_FIELDS} FROM te),
er AS (SELECT run, {_RUN_FIELDS} FROM (SELECT DISTINCT run FROM te))
"""

_DRIVERS = f"""
dr AS (
  SELECT o_orderkey,
    CASE WHEN o_orderstatus = 'O' THEN 'np' ELSE 'sp' END || '_' ||
    {_case('c_mktsegment', SEGMENT_FS)} || '_' || {_pick(ITERATIONS, 'o_custkey')} || 'it' ||
    {_case('o_orderpriority', PRIORITY_TAG)} || '_' || {_pick(DELAYS, 'o_orderkey')} ||
    'delay.out' AS run,
    (extract(day FROM o_orderdate) * 60)::DOUBLE AS start,
    (extract(day FROM o_orderdate) * 60)::DOUBLE + o_totalprice / 1000::DOUBLE AS "end"
  FROM orders JOIN customer ON o_custkey = c_custkey),
ms AS (
  SELECT run, CASE WHEN contains(run, 'np') THEN max("end") - min(start)
    ELSE arg_min("end", o_orderkey) END AS makespan
  FROM dr GROUP BY run),
mr AS (SELECT run, makespan, {_RUN_FIELDS} FROM ms)
"""

_CONDITION = ("iterations", "blocks", "image", "delay")
_CURVE = f"""
base AS (
  SELECT iterations, blocks, image, delay, min(makespan) AS baseline
  FROM mr WHERE engine = 'sp' AND fs = 'mem' GROUP BY ALL),
su AS (
  SELECT mr.*, baseline, makespan / baseline AS speedup
  FROM mr JOIN base USING ({', '.join(_CONDITION)})
  WHERE engine = 'sp' AND fs <> 'mem')
"""


def _dims(source: str) -> str:
    gamma = _case("blocks", fixed.NODE_CONCURRENCY)
    cluster = _case("blocks", fixed.CLUSTER_CONCURRENCY)
    return f"""
dm AS (
  SELECT *, {_case('image', fixed.IMAGE_MIB)} AS image_mib, {_case('fs', fixed.FS_MIB_PER_S)} AS fs_mib_s,
    ({gamma})::INT AS gamma, ({cluster})::INT AS gamma_cluster
  FROM {source}),
cd AS (SELECT *, delay * iterations * blocks AS c, image_mib * iterations AS d FROM dm),
rt AS (
  SELECT *, CASE WHEN fs = 'tmpfs' THEN d
    ELSE (d / c) / (fs_mib_s / (CASE WHEN fs = 'lustre' THEN gamma_cluster ELSE gamma END)) END AS rate
  FROM cd)
"""


_CONDITIONS = f"""
cn AS (
  SELECT p_partkey, p_size + 0.5::DOUBLE AS experiment,
    {_pick(['spark', 'workflow'], 'p_partkey')} AS framework,
    {_pick(FS, 'p_partkey // 2')} AS filesystem,
    ({_pick(DELAYS, 'p_partkey // 8')})::DOUBLE AS delay,
    {_pick(DELAYS, 'p_partkey // 8')} AS delay_text,
    {_pick(list(fixed.DATASETS), 'p_size')} AS dataset,
    ({_pick(ITERATIONS, 'p_partkey // 64')})::INT AS iterations
  FROM part)
"""

_CHUNK_MB = f"""
  CASE image WHEN 'HBB' THEN {fixed.HBB_CHUNK_BYTES}::DOUBLE / {fixed.MIB}
    WHEN 'BB' THEN {fixed.BB_TOTAL_MB}::DOUBLE / blocks
    ELSE {fixed.MRI_CHUNK_BYTES}::DOUBLE / {fixed.MIB} END
"""

_BANDWIDTHS = f"""
bw AS (
  SELECT event_id, engine, fs, CASE name WHEN 'read_file' THEN 'read' ELSE 'write' END AS op,
    ("end" - start = 0)::INT AS floored,
    ({_CHUNK_MB}) / (CASE WHEN "end" - start = 0 THEN {fixed.ZERO_DURATION_FLOOR_S}::DOUBLE
      ELSE "end" - start END) AS mb_s
  FROM ne WHERE fs <> 'mem' AND name IN ('read_file', 'write_file'))
"""

_LINE = """name || ' ' || start::DECIMAL(26,6)::VARCHAR || ' ' || "end"::DECIMAL(26,6)::VARCHAR || ' '
    || node || ' ' || filename || ' ' || executor::VARCHAR"""

_TEN = "x"
for _ in range(10):
    _TEN = f"({_TEN} + 1::FLOAT)"


def _plus(n: int, one: str) -> str:
    """n additions, one after the other."""
    text = "x"
    for _ in range(n):
        text = f"({text} + {one})"
    return text


def _voxels(keys: str, expression: str, source: str = "embeddings") -> str:
    return f"""
      SELECT {keys}, unnest(range(len(v)))::INT AS pos, unnest(v)::DOUBLE AS voxel
      FROM (SELECT *, {expression} AS v FROM {source})"""


_QUANTITIES = """(
    SELECT l_orderkey, list(l_quantity::INT ORDER BY l_linenumber, l_quantity::INT, l_partkey) AS q
    FROM lineitem GROUP BY l_orderkey)"""
_GRID = "(l_partkey // 500)::INT AS cx, (l_suppkey // 20)::INT AS cy, ((l_linenumber - 1) // 2)::INT AS cz"
_IMAGE_NAMES = """
im AS (
  SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'inc-' WHEN 2 THEN 'inc-inc-' WHEN 3 THEN 'province-' ELSE '' END
    || string_split(url, '/')[-1] || '.nii' AS base
  FROM pages)
"""


def _report(exp: int) -> str:
    keep = {
        1: f"delay = {fixed.EXP1_DELAY}::DOUBLE",
        2: f"delay IN ({', '.join(f'{d}::DOUBLE' for d in fixed.EXP2_DELAYS)})",
        3: f"delay = {fixed.EXP3_DELAY}::DOUBLE",
        4: f"delay IN ({', '.join(f'{d}::DOUBLE' for d in fixed.EXP4_DELAYS)})"
        f" AND iterations = {fixed.EXP4_ITERATIONS}",
    }[exp]
    label = {
        1: "iterations::VARCHAR",
        2: "blocks::VARCHAR",
        3: "image",
        4: "CASE WHEN delay = 320 THEN '320' ELSE delay::VARCHAR END",
    }[exp]
    return f"""
      SELECT engine || '_' || fs AS series, {label} AS label,
        round(avg(makespan::DECIMAL(20,5)), 9) AS makespan
      FROM mr WHERE {keep} GROUP BY ALL"""


def _axis(exp: int) -> str:
    rows = ", ".join(f"({i}, '{label}')" for i, label in enumerate(fixed.AXES[exp]))
    return f"(VALUES {rows}) AS axis(pos, label)"


_SERIES = [f"{engine}_{fs}" for engine, fs in fixed.SERIES]


def _comparison(exp: int) -> str:
    columns = ", ".join(
        f"max(CASE WHEN series = '{s}' THEN makespan END) AS {s}" for s in _SERIES
    )
    listed = ", ".join(f"'{s}'" for s in _SERIES)
    return f"""WITH {_DRIVERS}, s AS ({_report(exp)})
      SELECT axis.pos, axis.label, {columns}
      FROM {_axis(exp)} JOIN s ON s.label = axis.label WHERE series IN ({listed}) GROUP BY 1, 2"""


def _positions() -> str:
    parts = [
        f"""SELECT {exp} AS exp, names.series, axis.label, axis.pos, s.makespan
          FROM {_axis(exp)} CROSS JOIN (SELECT unnest({_list(_SERIES)}) AS series) AS names
          LEFT JOIN ({_report(exp)}) AS s ON s.label = axis.label AND s.series = names.series"""
        for exp in (1, 2, 3, 4)
    ]
    return f"WITH {_DRIVERS} " + " UNION ALL ".join(parts)


def oracle_sql() -> dict[str, str]:
    run_name = """
      CASE WHEN framework = 'spark' THEN 'sp' ELSE 'np' END || '_' || filesystem || '_' ||
      iterations::VARCHAR || 'it' || TAG || '_' || delay_text || 'delay.out'
    """.replace("TAG", _case("dataset", {k: t for k, (t, _) in fixed.DATASETS.items()}))
    sql = {
        "chk_increment": _voxels("vec_id", "list_transform(embedding, lambda x: x + 1::FLOAT)"),
        "chk_iterate_n": _voxels("vec_id", f"list_transform(embedding, lambda x: {_TEN})"),
        "chk_increment_int": _voxels(
            "l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN 'uint16' ELSE 'int32' END AS dtype",
            "list_transform(q, lambda x: x + 10)", _QUANTITIES),
        "chk_increment_wrap": _voxels(
            "l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN 'uint8' ELSE 'int8' END AS dtype",
            "list_transform(q, lambda x: CASE WHEN l_orderkey % 2 = 0 THEN (x + 220) % 256"
            " ELSE (x + 220 + 128) % 256 - 128 END)", _QUANTITIES),
        "chk_split_saved": """
          WITH v AS (
            SELECT 'img' || label AS image, vec_id, unnest(range(len(embedding)))::INT AS p, unnest(embedding)::DOUBLE AS voxel
            FROM embeddings
          ), c AS (
            SELECT *, p % 4 AS x, (p // 4) % 4 AS y, p // 16 AS z FROM v
          )
          SELECT image, (vec_id * 4 + x // 2 * 2)::INT AS x0, (y // 2 * 2)::INT AS y0, (z // 2 * 2)::INT AS z0,
            (x % 2 + 2 * (y % 2) + 4 * (z % 2))::INT AS pos, voxel FROM c""",
        "chk_all_steps_arrays": " UNION ALL ".join(
            _voxels(f"'float' AS kind, vec_id AS id, {i} AS iteration", f"list_transform(embedding, lambda x: {_plus(i, '1::FLOAT')})")
            for i in range(1, 5)
        ) + " UNION ALL " + " UNION ALL ".join(
            _voxels(f"'integer' AS kind, l_orderkey AS id, {i} AS iteration", f"list_transform(q, lambda x: x + {i})", _QUANTITIES)
            for i in range(1, 5)
        ),
        "chk_named_outputs": """
          WITH v AS (
            SELECT vec_id, unnest(range(64))::INT AS pos, floor(unnest(embedding)::DOUBLE * 256) AS f FROM embeddings
          ), l AS (
            SELECT vec_id, pos // 16 AS z, sum(f) AS s FROM v GROUP BY ALL
          ), m AS (
            SELECT vec_id, max(s) AS largest, arg_min(z, (-s, z))::INT AS layer,
              string_agg(s::BIGINT::VARCHAR, ',' ORDER BY z) AS layer_sums FROM l GROUP BY vec_id
          )
          SELECT vec_id, layer, layer_sums, pos, f - largest AS voxel FROM v JOIN m USING (vec_id)""",
        "chk_rechunk_slabs": """
          WITH v AS (
            SELECT 'img' || label AS image, vec_id, embedding, x, y, z
            FROM embeddings, range(6) AS a(x), range(6) AS b(y), range(6) AS c(z)
          )
          SELECT image, (vec_id * 6 + x // 3 * 3)::INT AS x0, (y // 3 * 3)::INT AS y0, (z // 3 * 3)::INT AS z0,
            (x % 3 + 3 * (y % 3) + 9 * (z % 3))::INT AS pos,
            CASE WHEN x < 4 AND y < 4 AND z < 4 THEN embedding[x + 4 * y + 16 * z + 1] ELSE 0 END::DOUBLE AS voxel FROM v""",
        "chk_join_parts": _voxels("'whole' || vec_id AS image", "embedding"),
        "snk_each_iteration": " UNION ALL ".join(
            _voxels(f"{i} AS iteration, '{name}-img' || label AS image, vec_id::INT AS x0",
                    f"list_transform(embedding, lambda x: {_plus(n, '1::FLOAT')})")
            for i, name, n in ((0, "inc", 1), (1, "inc", 2), (2, "inc", 3), (3, "inc3", 3))
        ),
        "snk_step_events": f"""
          SELECT name, filename, 1::BIGINT AS n, TRUE AS in_order FROM (
            SELECT unnest(['{fixed.READ_IMG}', 'twice', 'flip', '{fixed.SAVE}']) AS name,
              'img' || label || '_' || vec_id || '_0_0.nii' AS filename FROM embeddings
            UNION ALL SELECT '{fixed.DRIVER}', '{fixed.ALL_FILES}')""",
        "snk_copy_verified": """
          SELECT 'doc-' || doc_id AS name, md5(coalesce(text, '')) AS md5, strlen(coalesce(text, '')) AS length,
            'SUCCESS' AS status FROM documents WHERE doc_id IS NOT NULL""",
        "chk_user_steps_slabs": _voxels(
            "vec_id",
            "list_transform(range(64), lambda p: embedding[p % 16 + 16 * (3 - p // 16) + 1] * 2::FLOAT)",
        ),
        "chk_iterate_all_steps": """
          SELECT l_linenumber - 1 AS z, iteration::INT AS iteration, (l_quantity::INT + iteration)::INT AS v,
            count(*) AS n_voxels
          FROM lineitem, generate_series(1, 10) AS g(iteration) GROUP BY ALL""",
        "chk_user_fn": """
          SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total
          FROM embeddings""",
        "chk_user_steps": _voxels(
            "vec_id",
            "list_transform(range(64), lambda p: embedding[p % 16 + 16 * (3 - p // 16) + 1] * 2::FLOAT)",
        ),
        "chk_grid_split": f"""
          SELECT {_GRID}, count(*) AS n_voxels, sum(l_quantity::INT)::BIGINT AS total
          FROM lineitem GROUP BY ALL""",
        "chk_half_split": f"""
          SELECT {_GRID}, count(*) AS n_voxels, sum(l_quantity::INT)::BIGINT AS total
          FROM lineitem
          WHERE l_linenumber - 1 < (SELECT max(l_linenumber) FROM lineitem) / 2.0 GROUP BY ALL""",
        "chk_grid_assemble": """
          WITH v AS (
            SELECT vec_id AS x, unnest(range(len(embedding)))::INT AS y, unnest(embedding) AS v
            FROM embeddings),
          c AS (
            SELECT (x // 8)::INT AS cx, (y // 16)::INT AS cy, (x % 8 + y % 16 * 8)::INT AS pos, v FROM v)
          SELECT k.cx, k.cy, p.pos::INT AS pos, coalesce(c.v, 0)::DOUBLE AS voxel
          FROM (SELECT DISTINCT cx, cy FROM c) AS k CROSS JOIN range(128) AS p(pos)
          LEFT JOIN c ON c.cx = k.cx AND c.cy = k.cy AND c.pos = p.pos""",
        "chk_array_split": """
          WITH v AS (
            SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings),
          w AS (SELECT vec_id, i % 4 AS x, i // 4 % 4 AS y, i // 16 AS z, v FROM v)
          SELECT vec_id, (x // 2)::INT AS cx, (y // 2)::INT AS cy, (z // 2)::INT AS cz,
            (x % 2 + 2 * (y % 2) + 4 * (z % 2))::INT AS pos, v::DOUBLE AS voxel FROM w""",
        "chk_zero_pad": _voxels(
            "vec_id", "list_concat(embedding, list_transform(range(11), lambda p: 0::FLOAT))"
        ),
        "chk_zero_pad_grid": _voxels(
            "vec_id",
            """list_transform(range(216), lambda p: CASE
                 WHEN p % 6 < 4 AND p // 6 % 6 < 4 AND p // 36 < 4
                 THEN embedding[p % 6 + 4 * (p // 6 % 6) + 16 * (p // 36) + 1] ELSE 0::FLOAT END)""",
        ),
        "src_images_by_path": _voxels(
            "CASE WHEN label < 5 THEN 'low' ELSE 'other' END AS part, 'img' || label AS image, vec_id::INT AS x0", "embedding"),
        "src_path_index": "SELECT url AS path, row_number() OVER (ORDER BY url) - 1 AS idx FROM pages",
        "src_path_list": """
          SELECT conv_id, turn, unnest(string_split(text, ',')) AS path FROM conversations""",
        "src_legend_tokens": f"""
          SELECT doc_id, unnest(range(len(t)))::INT AS pos, unnest(t) AS token
          FROM (SELECT doc_id, list_filter(string_split_regex(text, '{WHITESPACE}'),
            lambda x: x <> '') AS t FROM documents)""",
        "src_conditions_json": f"""WITH {_CONDITIONS}
          SELECT p_partkey, experiment, framework, filesystem, delay, dataset, iterations FROM cn""",
        "snk_result_manifest": """
          SELECT vec_id, '/out/inc10-img' || label || '_' || vec_id || '_0_0.nii' AS out_path,
            'SUCCESS' AS status FROM embeddings""",
        "src_binary_scan": _voxels(
            "'img' || label AS image, vec_id::INT AS x0, (352 + 4 * len(embedding))::BIGINT AS length", "embedding"
        ),
        "snk_image_roundtrip": _voxels(
            "'img' || label AS image, vec_id::INT AS x0, 0 AS y0, 0 AS z0, 'float32' AS dtype",
            f"list_transform(embedding, lambda x: {_TEN})",
        ),
        "scl_md5": "SELECT doc_id, md5(text) AS md5 FROM documents",
        "nam_basename": """
          SELECT page_id, string_split(url, '/')[-1] AS base, regexp_replace(url, '/[^/]*$', '') AS dir,
            regexp_replace(url, '/[^/]*$', '') || '/x.nii' AS sibling FROM pages""",
        "nam_intermediate": f"""WITH {_IMAGE_NAMES}
          SELECT page_id, CASE WHEN starts_with(base, 'inc-') THEN base ELSE 'inc-' || base END AS by_prefix,
            CASE WHEN contains(base, 'inc') THEN base ELSE 'inc-' || base END AS by_anywhere FROM im""",
        "nam_final": f"""WITH {_IMAGE_NAMES}
          SELECT page_id, 'inc10-' || replace(base, 'inc-', '') AS out_name FROM im""",
        "nam_strip_scheme": """
          SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/' || url ELSE url END AS path FROM pages""",
        "nam_chunk_offsets": f"""
          SELECT l_orderkey, regexp_extract(n, '{CHUNK_NAME}', 1) AS image,
            regexp_extract(n, '{CHUNK_NAME}', 2)::INT AS x0, regexp_extract(n, '{CHUNK_NAME}', 3)::INT AS y0,
            regexp_extract(n, '{CHUNK_NAME}', 4)::INT AS z0
          FROM (SELECT l_orderkey, 'img_' || l_partkey || '_' || l_suppkey || '_' || l_linenumber || '.nii' AS n
            FROM lineitem)""",
        "evt_render": f"WITH {_TASKS} SELECT event_id, run, {_LINE} AS line FROM te",
        "evt_parse": f"""WITH {_TASKS},
          l0 AS (SELECT event_id, run, {_LINE} AS line FROM te),
          l1 AS (SELECT event_id, run, CASE event_id % 10 WHEN 7 THEN replace(line, 'read_file', 'Read file')
            WHEN 3 THEN replace(line, ' node', ' on node') ELSE line END AS line FROM l0),
          l2 AS (SELECT *, regexp_matches(line, '{EVENT_LINE}') AS ok FROM l1)
          SELECT event_id, run,
            CASE WHEN ok THEN CASE regexp_extract(line, '{EVENT_LINE}', 1) WHEN 'Read file' THEN 'read_file'
              WHEN 'Write file' THEN 'write_file' ELSE regexp_extract(line, '{EVENT_LINE}', 1) END END AS name,
            CASE WHEN ok THEN regexp_extract(line, '{EVENT_LINE}', 2)::DOUBLE END AS start,
            CASE WHEN ok THEN regexp_extract(line, '{EVENT_LINE}', 3)::DOUBLE END AS "end",
            CASE WHEN ok THEN regexp_extract(line, '{EVENT_LINE}', 4) END AS node,
            CASE WHEN ok THEN regexp_extract(line, '{EVENT_LINE}', 5) END AS filename,
            CASE WHEN ok THEN regexp_extract(line, '{EVENT_LINE}', 6)::BIGINT END AS executor,
            CASE WHEN NOT ok THEN line END AS _corrupt
          FROM l2""",
        "evt_duration": f"""WITH {_TASKS} SELECT event_id, round("end" - start, 6) AS seconds FROM te""",
        "evt_rebase": f"""WITH {_TASKS},
          s AS (SELECT *, CASE WHEN starts_with(run, 'np_') THEN coalesce(
            min(CASE WHEN name = 'driver_program' THEN start END) OVER (PARTITION BY run), 0)
            ELSE 0 END AS shift FROM te)
          SELECT event_id, run, round(start - shift, 6) AS start, round("end" - shift, 6) AS "end" FROM s""",
        "evt_relative_time": f"""WITH {_TASKS}
          SELECT event_id, round(start - min(CASE WHEN name = 'driver_program' THEN start END)
            OVER (PARTITION BY run), 6) AS since_driver FROM te""",
        "evt_seq_id": f"""WITH {_TASKS}
          SELECT event_id, row_number() OVER (ORDER BY start, event_id) - 1 AS id
          FROM te WHERE name <> 'driver_program'""",
        "evt_merge_union": f"""WITH {_TASKS},
          u AS (SELECT * FROM te WHERE name = 'driver_program'
            UNION ALL SELECT * FROM te WHERE name <> 'driver_program')
          SELECT run, name, count(*) AS n FROM u GROUP BY ALL""",
        "evt_timeline_json": f"""WITH {_TASKS},
          k AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS id FROM te
            WHERE name NOT IN ('read_file', 'write_file'))
          SELECT event_id, id, '{{"name":"' || name || '","id":' || id || ',"start-time":'
            || start::DECIMAL(20,6)::VARCHAR || ',"end-time":' || "end"::DECIMAL(20,6)::VARCHAR
            || ',"node":"' || node || '"}}' AS task FROM k""",
        "cnd_parse": f"WITH {_TASKS} SELECT event_id, run, engine, fs, iterations, blocks, image, delay FROM ne",
        "cnd_render": f"WITH {_CONDITIONS} SELECT p_partkey, {run_name} AS run FROM cn",
        "cnd_roundtrip": f"""WITH {_CONDITIONS}
          SELECT framework, filesystem, count(*) AS n, count(*) AS n_same FROM cn GROUP BY ALL""",
        "cnd_dataset_join": f"""WITH {_CONDITIONS},
          g AS (SELECT {_pick(list(fixed.DATASETS), 'page_id')} AS dataset, count(*) AS n FROM pages GROUP BY 1)
          SELECT p_partkey, cn.dataset,
            '/data/' || {_case('cn.dataset', {k: v[0] for k, v in fixed.DATASET_PATHS.items()})} AS chunk_dir,
            '/data/' || {_case('cn.dataset', {k: v[1] for k, v in fixed.DATASET_PATHS.items()})} AS legend_path,
            ({_case('cn.dataset', {k: v[1] for k, v in fixed.DATASETS.items()})})::INT AS cpus_per_task,
            coalesce(n, 0) AS n_images, coalesce(n, 0) // 15 AS per_node, coalesce(n, 0) % 15 AS nodes_with_one_more
          FROM cn LEFT JOIN g USING (dataset)""",
        "cnd_node_lists": f"""WITH {_CONDITIONS},
          g AS (
            SELECT dataset, path, ntile(15) OVER (PARTITION BY dataset ORDER BY path) - 1 AS grp FROM (
              SELECT {_pick(list(fixed.DATASETS), 'page_id')} AS dataset, url FROM pages) AS p,
              LATERAL (SELECT '/data/' || {_case('dataset', {k: v[0] for k, v in fixed.DATASET_PATHS.items()})} || '/' || url AS path)
          ), s AS (
            SELECT *, (row_number() OVER (PARTITION BY dataset, grp ORDER BY path) - 1) // 20 AS segment FROM g
          ), lists AS (
            SELECT dataset, grp::INT AS grp, segment::INT AS segment, count(*) AS n_paths,
              md5(string_agg(path, ',' ORDER BY path)) AS paths_md5 FROM s GROUP BY ALL
          )
          SELECT p_partkey, dataset, grp, segment, n_paths, paths_md5 FROM cn JOIN lists USING (dataset)""",
        "mks_multi_driver": f"""WITH {_TASKS}
          SELECT run, round(max("end") - min(start), 6) AS makespan FROM te
          WHERE name = 'driver_program' GROUP BY run""",
        "mks_single_driver": f"""WITH {_TASKS}
          SELECT run, round(arg_min("end", event_id), 6) AS makespan FROM te
          WHERE name = 'driver_program' GROUP BY run""",
        "mks_join_runs": f"""WITH {_TASKS}, {_DRIVERS}
          SELECT run, round(makespan, 6) AS makespan, er.engine, er.fs, er.iterations, er.blocks, er.image, er.delay
          FROM ms JOIN er USING (run)""",
        "mks_line_render": f"""WITH {_TASKS}
          SELECT run, run || ':driver_program 0 ' || (max("end") - min(start))::DECIMAL(26,6)::VARCHAR || ' '
            || min(node) || ' allfiles ' || min(executor)::VARCHAR AS value
          FROM te WHERE name = 'driver_program' GROUP BY run""",
        "mks_line_parse": f"""WITH {_TASKS}, l AS (
          SELECT run || ':driver_program 0 ' || (max("end") - min(start))::DECIMAL(26,6)::VARCHAR || ' '
            || min(node) || ' allfiles ' || min(executor)::VARCHAR AS value
          FROM te WHERE name = 'driver_program' GROUP BY run)
          SELECT string_split(value, ':')[1] AS run,
            string_split(string_split(value, ':')[2], ' ')[3]::DOUBLE AS makespan FROM l""",
        "iob_chunk_size": f"WITH {_TASKS} SELECT run, round({_CHUNK_MB}, 6) AS chunk_mb FROM er",
        "iob_bandwidth": f"""WITH {_TASKS}, {_BANDWIDTHS}
          SELECT event_id, engine, fs, op, round(mb_s, 6) AS mb_s FROM bw""",
        "iob_distribution": f"""WITH {_TASKS}, {_BANDWIDTHS}
          SELECT engine, fs, op, count(*) AS n, sum(floored)::BIGINT AS n_floored,
            round(min(mb_s), 6) AS min_mb_s, round(max(mb_s), 6) AS max_mb_s,
            round(quantile_cont(mb_s, 0.25), 6) AS p25_mb_s, round(quantile_cont(mb_s, 0.5), 6) AS median_mb_s,
            round(quantile_cont(mb_s, 0.75), 6) AS p75_mb_s
          FROM (SELECT * FROM bw UNION ALL SELECT * REPLACE ('all' AS engine) FROM bw) GROUP BY ALL""",
        "iob_sketch": f"""WITH {_TASKS}, {_BANDWIDTHS}
          SELECT engine, fs, op, point::DOUBLE AS point, n, TRUE AS within FROM (
            SELECT engine, fs, op, count(mb_s) AS n
            FROM (SELECT * FROM bw UNION ALL SELECT * REPLACE ('all' AS engine) FROM bw) GROUP BY ALL HAVING n > 0),
            (SELECT unnest([0.25, 0.5, 0.75]) AS point)""",
        "iob_by_fs_and_engine": f"""WITH {_TASKS}, {_BANDWIDTHS}
          SELECT engine, fs, op, count(*) AS n, round(max(mb_s), 6) AS max_mb_s FROM bw GROUP BY ALL
          UNION ALL
          SELECT 'all', fs, op, count(*), round(max(mb_s), 6) FROM bw GROUP BY ALL""",
        "iob_histogram": f"""WITH {_TASKS}, {_BANDWIDTHS}
          SELECT engine, fs, op, floor(mb_s / 50)::BIGINT AS bucket, count(*) AS n FROM bw GROUP BY ALL""",
        "iob_write_time_by_count": f"""WITH {_TASKS}
          SELECT blocks, round(sum("end" - start), 4) AS write_seconds FROM ne
          WHERE name = 'write_file' GROUP BY ALL""",
        "iob_realized_bw": f"""WITH {_TASKS}
          SELECT engine, fs, round(sum({_CHUNK_MB}) / sum("end" - start), 6) AS mb_s FROM ne
          WHERE name = 'write_file' GROUP BY ALL""",
        "mod_dims_join": f"""WITH {_TASKS}, {_dims('er')}
          SELECT run, round(image_mib, 6) AS image_mib, fs_mib_s, gamma, gamma_cluster FROM dm""",
        "mod_cd": f"WITH {_TASKS}, {_dims('er')} SELECT run, round(c, 6) AS c, round(d, 6) AS d FROM cd",
        "mod_rate": f"""WITH {_TASKS}, {_dims('er')}
          SELECT run, round(rate, 6) AS rate FROM rt WHERE fs <> 'mem'""",
        "mod_region": f"""WITH {_DRIVERS}, {_CURVE}, {_dims('su')}
          SELECT run, CASE WHEN (rate > 1 AND speedup < 1) OR (rate < 1 AND speedup > 1) THEN 'violation'
            WHEN rate <= 1 THEN 'cached' ELSE 'limited' END AS region, (rate <= 1)::INT AS cache_covers
          FROM rt WHERE fs <> 'tmpfs'""",
        "mod_breakeven": """
          WITH r AS (
            SELECT l_suppkey, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS mb,
              (sum(l_quantity::BIGINT) * 1200)::DOUBLE AS seconds FROM lineitem GROUP BY ALL)
          SELECT l_suppkey, fs, round(bw / (mb / seconds))::BIGINT AS break_even
          FROM r CROSS JOIN (VALUES ('lustre', 504.03::DOUBLE), ('local', 193.64::DOUBLE)) AS s(fs, bw)""",
        "mod_speedup": f"""WITH {_DRIVERS}, {_CURVE}
          SELECT run, round(baseline, 6) AS baseline, round(speedup, 6) AS speedup FROM su""",
        "mod_speedup_curve": f"""WITH {_DRIVERS}, {_CURVE}, {_dims('su')}
          SELECT fs, run, round(rate, 6) AS rate, round(speedup, 6) AS speedup FROM rt""",
        "mod_avg_slowdown": f"""WITH {_DRIVERS}, {_CURVE},
          m AS (SELECT fs, iterations, blocks, image, delay, avg(makespan) AS mean_makespan, count(*) AS n_runs
            FROM mr WHERE fs <> 'mem' GROUP BY ALL)
          SELECT fs, iterations, blocks, image, delay, n_runs, round(mean_makespan / baseline, 6) AS slowdown
          FROM m JOIN base USING (iterations, blocks, image, delay)""",
        "mod_linear_fit": f"""WITH {_DRIVERS}, {_CURVE}, {_dims('su')}
          SELECT fs, count(*) AS n, round(regr_slope(speedup, rate), 9) AS slope,
            round(regr_intercept(speedup, rate), 6) AS intercept FROM rt GROUP BY fs""",
        "mod_concurrency": f"""WITH {_TASKS},
          p AS (SELECT node, start AS t, 1 AS delta FROM te WHERE name <> 'driver_program'
            UNION ALL SELECT node, "end", -1 FROM te WHERE name <> 'driver_program'),
          n AS (SELECT node, sum(delta) OVER (PARTITION BY node ORDER BY t, delta) AS tasks FROM p),
          c AS (SELECT sum(delta) OVER (ORDER BY t, delta) AS tasks FROM p)
          SELECT node, max(tasks)::BIGINT AS max_tasks FROM n GROUP BY node
          UNION ALL SELECT 'cluster', max(tasks)::BIGINT FROM c""",
        "rpt_axis_position": _positions(),
        "asg_ntile": """
          SELECT o_orderkey, (ntile(15) OVER (ORDER BY o_orderkey) - 1)::INT AS grp FROM orders""",
        "asg_group_csv": """
          WITH g AS (SELECT url, ntile(15) OVER (ORDER BY url) - 1 AS grp FROM pages),
          s AS (SELECT *, (row_number() OVER (PARTITION BY grp ORDER BY url) - 1) // 100 AS segment FROM g)
          SELECT grp::INT AS grp, segment::INT AS segment, count(*) AS n_paths,
            string_agg(url, ',' ORDER BY url) AS paths FROM s GROUP BY ALL""",
        "asg_by_bytes": """
          SELECT doc_id, strlen(text)::INT AS bytes,
            least(14, (sum(coalesce(strlen(text), 0)) OVER (ORDER BY doc_id) - coalesce(strlen(text), 0)) * 15
              // greatest(1, sum(coalesce(strlen(text), 0)) OVER ()))::INT AS grp FROM documents""",
        "asg_counts": f"""WITH {_TASKS}
          SELECT engine, fs, count(*) AS n_events, count(DISTINCT run) AS n_conditions,
            count(DISTINCT filename) FILTER (name <> 'driver_program') AS n_images FROM ne GROUP BY ALL""",
        "asg_by_dataset": f"""WITH {_CONDITIONS}
          SELECT p_partkey, dataset, row_number() OVER (PARTITION BY dataset ORDER BY p_partkey) - 1 AS idx,
            count(*) OVER (PARTITION BY dataset) AS total,
            (ntile(15) OVER (PARTITION BY dataset ORDER BY p_partkey) - 1)::INT AS grp FROM cn""",
        "asg_shuffled": f"WITH {_CONDITIONS} SELECT p_partkey, dataset FROM cn",
    }
    for exp in (1, 2, 3, 4):
        sql[f"rpt_exp{exp}"] = _comparison(exp)
    return sql
