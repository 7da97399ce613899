"""The views of shelfmark.plans.adapters and the fixed lists as DuckDB text."""

from __future__ import annotations

from shelfmark.functions import classify as c

FILES = r"""
files AS (
  SELECT doc_id AS file_id, 'docs/' || lang || '/' || source || '/doc ' || doc_id || '.txt' AS path, octet_length(encode(text))::BIGINT AS size, 'text/plain' AS mime, text AS content FROM documents
  UNION ALL
  SELECT page_id + 10000000, 'web/' || regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', ''), octet_length(encode(html))::BIGINT, 'text/html', html FROM pages
  UNION ALL
  SELECT conv_id * 1000 + turn + 20000000, 'chat/' || conv_id || '/' || turn || '.txt', octet_length(encode(text))::BIGINT, 'text/plain', text FROM conversations
  UNION ALL
  SELECT p_partkey + 30000000, 'music/' || p_brand || '/' || p_type || '/' || p_name || ' ' || p_partkey || '.flac', floor(p_retailprice * 1000)::BIGINT, 'audio/flac', NULL FROM part)"""

MUSIC_RAW = r"""
music AS (
  SELECT p_partkey + 30000000 AS file_id, seq, namespace, key, value FROM part, LATERAL (VALUES
    (1, 'vorbis', 'artist', p_brand), (2, 'vorbis', 'ALBUMARTIST ', p_brand), (3, 'vorbis', 'album', p_type), (4, 'vorbis', 'track', p_partkey::VARCHAR),
    (5, 'vorbis', 'genre', replace(p_name, ' ', '; ') || '; ' || string_split(p_name, ' ')[1]), (6, 'vorbis', 'year', (1950 + p_size)::VARCHAR),
    (7, 'tika', 'samplerate', p_size || '.5 kHz'), (8, 'tika', 'bitrate', (64 + p_partkey % 300) || ' kbps'), (9, 'tika', 'replaygain_track_gain', '-' || p_size || '.25 dB'),
    (10, 'xmpdm', 'duration', p_size || ':' || lpad((p_partkey % 60)::VARCHAR, 2, '0')), (11, 'tika', 'tracktotal', '1,' || lpad((p_partkey % 1000)::VARCHAR, 3, '0')),
    (12, 'xmpdm', 'artist', p_brand), (13, 'tika', 'comment-x', p_name)) AS v(seq, namespace, key, value))"""

TEXT_RAW = r"""
texts AS (
  SELECT doc_id AS file_id, seq, namespace, key, value FROM documents, LATERAL (VALUES (1, 'dc', 'language', lang), (2, 'dc', 'publisher', source), (3, 'tika', 'content-type', 'text/plain; charset=utf-8')) AS v(seq, namespace, key, value)
  UNION ALL
  SELECT page_id + 10000000, seq, namespace, key, value FROM pages, LATERAL (VALUES (1, 'dc', 'title', regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), (2, 'tika', 'content-type', 'text/html')) AS v(seq, namespace, key, value))"""

RAW = MUSIC_RAW + "," + TEXT_RAW + ",\nraw AS (SELECT * FROM music UNION ALL SELECT * FROM texts)"

#: Text attributes of music and text files, by definition.
TEXTS = r"""
text_attributes AS (
  SELECT file_id, CASE trim(lower(key)) WHEN 'artist' THEN 7 WHEN 'albumartist' THEN 3 WHEN 'album' THEN 2 WHEN 'language' THEN 54 WHEN 'publisher' THEN 59 WHEN 'title' THEN 73 END AS definition, seq, namespace, key, value
  FROM raw WHERE trim(lower(key)) IN ('artist', 'albumartist', 'album', 'language', 'publisher', 'title')
  UNION ALL SELECT file_id, 41, seq, namespace, key, trim(split_part(value, ';', 1)) FROM raw WHERE key = 'content-type'
  UNION ALL SELECT file_id, 92, seq, namespace, key, g FROM (SELECT file_id, seq, namespace, key, unnest(list_distinct(list_transform(string_split(value, ';'), lambda x: trim(x)))) AS g FROM raw WHERE key = 'genre') WHERE g <> '')"""

TREE = r"""
placed AS (
  SELECT o_orderkey AS k, o_orderkey % 7 AS f, o_orderkey % 11 AS n, o_totalprice AS price FROM orders),
listed AS (
  SELECT k, price, 'tree/Show ' || (k % 40) || CASE f WHEN 0 THEN '/Season 1' WHEN 1 THEN '/Season 2' WHEN 2 THEN '/extras' WHEN 3 THEN '/Movie ' || (k % 100) WHEN 4 THEN '/App ' || (k % 60) ELSE '' END || '/' ||
    CASE WHEN f = 4 THEN CASE WHEN n < 4 THEN 'app' || (k % 60) || '.exe' WHEN n < 6 THEN 'setup.exe' WHEN n < 9 THEN 'engine.dll' ELSE 'readme.txt' END
         ELSE CASE n WHEN 2 THEN 'track ' || (k % 500) || '.lrc' WHEN 3 THEN 'cover.jpg' WHEN 4 THEN 'Movie ' || (k % 100) || '.mkv' WHEN 5 THEN 'show.nfo'
              WHEN 7 THEN 'notes ' || (k % 50) || '.txt' WHEN 8 THEN 'notes ' || (k % 50) || '.txt' WHEN 9 THEN 'book.opf' WHEN 10 THEN 'Movie ' || (k % 100) || '.srt' ELSE 'track ' || (k % 500) || '.flac' END END AS path FROM placed),
tree AS (SELECT path, min(k) AS file_id, max(floor(price))::BIGINT AS size FROM listed GROUP BY path)"""


def inlist(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


EXT = r"lower(regexp_extract(name, '(\.[^./\\]*)$', 1))"
STEM = r"lower(regexp_replace(name, '\.[^./\\]*$', ''))"
KIND = f"""CASE WHEN lower(name) LIKE '%.info.json' THEN 'CompanionResource' WHEN {EXT} = '.opf' THEN 'Opf' WHEN {EXT} = '.lrc' THEN 'Lrc' WHEN {EXT} = '.nfo' THEN 'Nfo'
  WHEN {EXT} IN {inlist(c.IMAGE_EXTENSIONS)} AND {STEM} IN {inlist(c.ART_STEMS)} THEN 'CompanionArt' WHEN {EXT} IN {inlist(c.SUBTITLE_EXTENSIONS + c.RESOURCE_EXTENSIONS)} THEN 'CompanionResource' ELSE 'Content' END"""
EXE = f"{EXT} IN {inlist(c.EXECUTABLE_EXTENSIONS)}"
AUX = f"({EXE} AND ({STEM} IN {inlist(c.AUXILIARY_STEMS)} OR starts_with({STEM}, 'unins')))"
PRIMARY = f"{EXT} IN {inlist(c.AUDIO_EXTENSIONS + c.VIDEO_EXTENSIONS + c.EXECUTABLE_EXTENSIONS)}"

ASSOCIATED = f"""
own AS (SELECT *, {KIND} AS kind, {PRIMARY} AS media, {EXE} AS exe, {AUX} AS aux, {STEM} AS stem FROM (
  SELECT file_id, path, size, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(path, '([^/]*)$', 1) AS name FROM tree)),
apps AS (SELECT folder FROM own GROUP BY folder HAVING bool_or(kind = 'Content' AND exe) AND bool_or(kind = 'CompanionResource')),
roots AS (SELECT folder AS root FROM apps a WHERE NOT EXISTS (SELECT 1 FROM apps b WHERE starts_with(a.folder, b.folder || '/'))),
spot AS (SELECT own.*, r.root FROM own LEFT JOIN roots r ON own.folder = r.root OR starts_with(own.folder, r.root || '/')),
graded AS (SELECT *, regexp_replace(stem, '[^a-z0-9]', '', 'g') AS skey, lower(regexp_replace(regexp_extract(root, '([^/]*)$', 1), '[^A-Za-z0-9]', '', 'g')) AS rkey FROM spot WHERE root IS NOT NULL),
g2 AS (SELECT *, CASE WHEN folder = root AND kind = 'Content' AND exe AND skey <> '' AND rkey <> '' AND (contains(rkey, skey) OR contains(skey, rkey)) THEN 3
                      WHEN folder = root AND kind = 'Content' AND exe AND NOT aux THEN 2 WHEN folder = root AND kind = 'Content' AND exe THEN 1 WHEN kind = 'Content' THEN 0 END AS grade FROM graded),
chosen AS (SELECT root, file_id AS primary_id FROM g2 WHERE grade IS NOT NULL QUALIFY row_number() OVER (PARTITION BY root ORDER BY grade DESC, CASE WHEN grade IN (0, 3) THEN 0 ELSE -size END, name, path) = 1),
bundled AS (SELECT g2.file_id, g2.path, g2.folder, g2.kind, CASE WHEN file_id = primary_id THEN 'Primary' WHEN kind IN ('Opf', 'Nfo', 'Lrc') THEN 'Sidecar' ELSE 'Companion' END AS role, primary_id AS item_id FROM g2 JOIN chosen USING (root)),
loose AS (SELECT *, bool_or(kind = 'Content' AND media) OVER (PARTITION BY folder) AS is_media FROM spot WHERE root IS NULL),
l2 AS (SELECT *, kind = 'Content' AND (NOT is_media OR media) AS is_real FROM loose),
l3 AS (SELECT *, count(*) FILTER (WHERE is_real) OVER (PARTITION BY folder) AS n_real, min(file_id) FILTER (WHERE is_real) OVER (PARTITION BY folder) AS only_id FROM l2),
tracks AS (SELECT folder, stem, arg_min(file_id, path) AS track_id FROM l3 WHERE is_real AND n_real > 1 GROUP BY ALL),
foldered AS (SELECT l3.file_id, l3.path, l3.folder, l3.kind, CASE WHEN is_real THEN 'Primary' WHEN kind IN ('Opf', 'Nfo', 'Lrc') THEN 'Sidecar' ELSE 'Companion' END AS role,
  CASE WHEN n_real = 1 THEN only_id WHEN is_real THEN file_id WHEN kind = 'Lrc' THEN track_id END AS item_id FROM l3 LEFT JOIN tracks t ON t.folder = l3.folder AND t.stem = l3.stem),
associated AS (SELECT * FROM bundled UNION ALL SELECT * FROM foldered)"""


def natural(name: str) -> str:
    """The sort key of shelfmark.functions.paths.natural_key, for names with ASCII digits."""
    runs = rf"regexp_extract_all({name}, '([0-9]+|[^0-9]+)', 1)"
    plain = "CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END"
    number = f"lpad(length({plain})::VARCHAR, 10, '0') || {plain} || lpad((2147483648 - length(x) + length({plain}))::VARCHAR, 10, '0')"
    return rf"array_to_string(list_transform({runs}, lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN {number} ELSE lower(x) END), '')"
