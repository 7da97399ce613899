"""Vocabulary, aliases and promotion rules.

Everything here is fixed values: names, keys and bounds that results depend on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

# id|group|name|type|unit|read-only
DEFINITIONS_TEXT = """
1|Audio|AcoustID ID|Text||
2|Audio|Album|Text||
3|Audio|Album artist|Text||
4|Audio|Album artist (sort)|Text||
5|Audio|Album gain|Float||
6|Audio|Album peak|Float|dB|
7|Audio|Artist|Text||
8|Audio|Artist (sort)|Text||
9|Audio|Beats per minute|Integer|bpm|
10|Audio|Bits per sample|Integer||read-only
11|Audio|Channels|Integer||read-only
12|Audio|Composer|Text||
13|Audio|Engineer|Text||
14|Audio|Initial key|Text||
15|Audio|Lyrics|BigText||
16|Audio|Original album|Text||
17|Audio|Reference loudness|Float||
18|Audio|Sample rate|Integer|Hz|read-only
19|Audio|Total tracks|Integer||read-only
20|Audio|Track |Integer||
21|Audio|Track artist|Text||
22|Audio|Track gain|Float||
23|Audio|Track peak|Float||
24|File attributes|Date created|Date||read-only
25|File attributes|Date modified|Date||read-only
26|File attributes|File extension|Text||read-only
27|File attributes|File name|Text||
28|File attributes|File type|Text||read-only
29|File attributes|Full path|Text||read-only
30|File attributes|Item count|Integer||read-only
31|File attributes|Mime type|Text||read-only
32|File attributes|Size|Integer|bytes|read-only
33|General|Amazon Standard Identification Number (ASIN)|Text||
34|General|Bar code|Text||
35|General|Catalog number|Text||
36|General|Category|Text||
37|General|Collection|Text||
38|General|Comment|BigText||
39|General|Compilation|Text||
40|General|Content rating|Text||
41|General|Content type|Text||
42|General|Copyright|BigText||
43|General|Credits|BigText||
44|General|Date created|Date||
45|General|Date released|Date||
46|General|Description|FormattedText||
47|General|Director|Text||
48|General|Display name|Text||
49|General|Encoded by|Text||
50|General|Encoder|Text||
51|General|Encoder settings|Text||
52|General|Id|Text||read-only
53|General|Index|Integer||read-only
54|General|Language|Text||
55|General|Location|Text||
56|General|Minor version|Text||
57|General|Organization|Text||
58|General|Product|Text||
59|General|Publisher|Text||
60|General|Release country|Text||
61|General|Release notes|FormattedText||
62|General|Release status|Text||
63|General|Release type|Text||
64|General|Script|Text||
65|General|Size|Integer||
66|General|Source|Text||
67|General|Source URL|Text||
68|General|Subcategory|Text||
69|General|Subtitle|Text||
70|General|Summary|BigText||
71|General|Synopsis|BigText||
72|General|Tag|Text||
73|General|Title|Text||
74|General|Unique file identifier (UFID)|Text||
75|General|Uploader|Text||
76|General|Written by|Text||
77|General|Year|Integer||
78|General|Year created|Integer||
79|Image|Aspect ratio|Float||read-only
80|Image|Height|Integer||read-only
81|Image|Pixels|Integer||read-only
82|Image|Width|Integer||read-only
83|Media|Actor|Text||
84|Media|Bit rate|Integer|bps|read-only
85|Media|Codec|Text||read-only
86|Media|Date recorded|Date||
87|Media|Disc|Integer||
88|Media|Duration|TimeSpan||read-only
89|Media|End time|TimeSpan||read-only
90|Media|Episode ID|Text||
91|Media|Episode number|Integer||
92|Media|Genre|Text||
93|Media|Label|Text||
94|Media|Media format|Text||
95|Media|MusicBrainz album artist ID|Text||
96|Media|MusicBrainz album ID|Text||
97|Media|MusicBrainz artist ID|Text||
98|Media|MusicBrainz release group ID|Text||
99|Media|MusicBrainz release track ID|Text||
100|Media|MusicBrainz track ID|Text||
101|Media|Narrated by|Text||
102|Media|Producer|Text||
103|Media|Screenplay by|Text||
104|Media|Season number|Integer||
105|Media|Start time|TimeSpan||read-only
106|Media|Stream type|Text||read-only
107|Media|Studio|Text||
108|Media|Total discs|Integer||
109|Package|Version|Text||
110|Software|Architecture|Text||
111|Software|End of life date|Date||
112|Software|Installation instructions|FormattedText||
113|Software|Minimum CPU|Text||
114|Software|Minimum disk space|Integer||
115|Software|Minimum RAM|Integer||
116|Software|Platform|Text||
117|Software|Serial key|Text||
118|Software|User interface|Text||
119|Video|Frame rate|Float|fps|read-only
120|Video|Frames|Integer||read-only
121|File attributes|Checksum|Text||read-only
122|Media|IMDb ID|Text||
123|Media|TMDb ID|Text||
124|Media|TVDB ID|Text||
"""

# Alias (lower case)|group|name|role
ALIASES_TEXT = """
acoustid_id|Audio|AcoustID ID|
album|Audio|Album|
album_artist|Audio|Album artist|
albumartistsort|Audio|Album artist (sort)|
replaygain_album_gain|Audio|Album gain|
replaygain_album_peak|Audio|Album peak|
artist|Audio|Artist|
artists|Audio|Artist|
artistsort|Audio|Artist (sort)|
tbp|Audio|Beats per minute|
composer|Audio|Composer|
tcm|Audio|Composer|
ieng|Audio|Engineer|
tke|Audio|Initial key|
toal|Audio|Original album|
replaygain_reference_loudness|Audio|Reference loudness|
tracktotal|Audio|Total tracks|
track|Audio|Track |
musicmatch_trackartist|Audio|Track artist|
replaygain_track_gain|Audio|Track gain|
replaygain_track_peak|Audio|Track peak|
mimetype|File attributes|Mime type|
asin|General|Amazon Standard Identification Number (ASIN)|
barcode|General|Bar code|
upc|General|Bar code|
catalognumber|General|Catalog number|
grouping|General|Collection|
comment|General|Comment|
compilation|General|Compilation|
law_rating|General|Content rating|
rating|General|Content rating|
content_type|General|Content type|
copyright|General|Copyright|
credits|General|Credits|
creation_time|General|Date created|
date|General|Date created|
originaldate|General|Date created|
date_release|General|Date released|
date_released|General|Date released|
tdr|General|Date released|
description|General|Description|
tds|General|Description|
director|General|Director|
encoded_by|General|Encoded by|
encoded-by|General|Encoded by|
encodedby|General|Encoded by|
encoder|General|Encoder|
software|General|Encoder|
encodersettings|General|Encoder settings|
tss|General|Encoder settings|
language|General|Language|
location|General|Location|
location-eng|General|Location|
minor_version|General|Minor version|
organization|General|Organization|
product|General|Product|
publisher|General|Publisher|
releasecountry|General|Release country|
releasestatus|General|Release status|
releasetype|General|Release type|
script|General|Script|
tsiz|General|Size|
isrc|General|Source|
tid|General|Source|
woas|General|Source URL|
subtitle|General|Subtitle|
tit3|General|Subtitle|
tt3|General|Subtitle|
summary|General|Summary|
synopsis|General|Synopsis|
title|General|Title|
ufid|General|Unique file identifier (UFID)|
uploader|General|Uploader|
written_by|General|Written by|
tyer|General|Year|
year|General|Year|
originalyear|General|Year created|
actor|Media|Actor|
bps|Media|Bit rate|
bps-eng|Media|Bit rate|
date_recorded|Media|Date recorded|
disc|Media|Disc|
duration|Media|Duration|
duration-eng|Media|Duration|
tlen|||Ignore
episodeid|Media|Episode ID|
episodenumber|Media|Episode number|
episode_sort|Media|Episode number|
genre|Media|Genre|
label|Media|Label|
media|Media|Media format|
musicbrainz_albumartistid|Media|MusicBrainz album artist ID|
musicbrainz_albumid|Media|MusicBrainz album ID|
musicbrainz_artistid|Media|MusicBrainz artist ID|
musicbrainz_releasegroupid|Media|MusicBrainz release group ID|
musicbrainz_releasetrackid|Media|MusicBrainz release track ID|
musicbrainz_trackid|Media|MusicBrainz track ID|
narratedby|Media|Narrated by|
producer|Media|Producer|
screenplay_by|Media|Screenplay by|
season_number|Media|Season number|
seasonnumber|Media|Season number|
production_studio|Media|Studio|
disctotal|Media|Total discs|
filename|||Ignore
show|General|Collection|
"""


@dataclass(frozen=True)
class Definition:
    id: int
    group: str
    name: str
    type: str
    unit: str | None
    read_only: bool


@dataclass(frozen=True)
class Alias:
    alias: str
    definition: int | None
    ignore: bool


@dataclass(frozen=True)
class Rule:
    namespace: str
    key: str
    kind: str
    definition: int
    coercer: str
    keep: str | None
    low: float | None
    high: float | None


def _lines(text: str) -> list[list[str]]:
    return [line.split("|") for line in text.strip("\n").split("\n")]


def definitions() -> list[Definition]:
    return [Definition(int(i), group, name, kind, unit or None, bool(ro)) for i, group, name, kind, unit, ro in _lines(DEFINITIONS_TEXT)]


def aliases() -> list[Alias]:
    by_name = {(d.group, d.name): d.id for d in definitions()}
    return [Alias(alias, by_name.get((group, name)), role == "Ignore") for alias, group, name, role in _lines(ALIASES_TEXT)]


def each(namespaces: tuple[str, ...], make: Callable[..., Rule], key: str, definition: int, **more: Any) -> list[Rule]:
    """The same rule in several namespaces."""
    return [make(namespace, key, definition, **more) for namespace in namespaces]


def text(namespace: str, key: str, definition: int, coercer: str = "text", keep: str | None = None) -> Rule:
    return Rule(namespace, key, "text", definition, coercer, keep, None, None)


def texts(namespace: str, key: str, definition: int, coercer: str = "text", keep: str | None = None) -> Rule:
    """Several texts, split at semicolons."""
    return Rule(namespace, key, "texts", definition, coercer, keep, None, None)


def integer(namespace: str, key: str, definition: int, coercer: str = "integer", low: float | None = None, high: float | None = None) -> Rule:
    return Rule(namespace, key, "integer", definition, coercer, None, low, high)


def float_(namespace: str, key: str, definition: int, coercer: str = "float", low: float | None = None, high: float | None = None) -> Rule:
    return Rule(namespace, key, "float", definition, coercer, None, low, high)


def date(namespace: str, key: str, definition: int, coercer: str = "iso_date") -> Rule:
    """Placeholders of a missing date are not kept."""
    return Rule(namespace, key, "date", definition, coercer, "real_date", None, None)


def duration(namespace: str, key: str, definition: int, coercer: str = "duration", low: float | None = None, high: float | None = None) -> Rule:
    return Rule(namespace, key, "duration", definition, coercer, None, low, high)


# The namespaces in which some rules stand alike.
CATALOGUE_NAMESPACES = ("tika", "matroska", "id3", "vorbis", "xmpdm", "quicktime")
TAG_NAMESPACES = ("vorbis", "id3")
# The rules, by namespace and key; of several for one namespace and key the last stands.
RULES = [
    text("dc", "title", 73),
    text("dc", "publisher", 59),
    text("dc", "description", 46),
    text("dc", "language", 54),
    texts("dc", "subject", 72, keep="meaningful_tag"),
    text("dc", "rights", 42),
    date("dcterms", "created", 44),
    date("dcterms", "modified", 45),
    text("tika", "content-type", 41, coercer="mime"),
    date("exif", "datetimeoriginal", 86, coercer="exif_date"),
    text("matroska", "title", 73),
    text("quicktime", "title", 73),
    texts("matroska", "genre", 92),
    text("matroska", "comment", 38),
    text("quicktime", "comment", 38),
    text("matroska", "description", 46),
    text("matroska", "synopsis", 71),
    text("matroska", "summary", 70),
    text("matroska", "show", 37),
    integer("matroska", "season_number", 104),
    integer("matroska", "episode_sort", 91),
    *each(CATALOGUE_NAMESPACES, text, "imdb_id", 122),
    *each(CATALOGUE_NAMESPACES, text, "imdbid", 122),
    *each(CATALOGUE_NAMESPACES, text, "imdb", 122),
    *each(CATALOGUE_NAMESPACES, text, "tmdb_id", 123),
    *each(CATALOGUE_NAMESPACES, text, "tmdbid", 123),
    *each(CATALOGUE_NAMESPACES, text, "themoviedb", 123),
    *each(CATALOGUE_NAMESPACES, text, "tvdb_id", 124),
    *each(CATALOGUE_NAMESPACES, text, "tvdbid", 124),
    *each(CATALOGUE_NAMESPACES, text, "thetvdb", 124),
    integer("file", "imagewidth", 82),
    integer("file", "imageheight", 80),
    integer("exif", "exifimagewidth", 82),
    integer("exif", "exifimageheight", 80),
    integer("png", "imagewidth", 82),
    integer("png", "imageheight", 80),
    integer("tiff", "imagewidth", 82),
    integer("tiff", "imagelength", 80),
    integer("tika", "image width", 82, coercer="integer_loose"),
    integer("tika", "image height", 80, coercer="integer_loose"),
    integer("quicktime", "imagewidth", 82),
    integer("quicktime", "imageheight", 80),
    text("xmpdm", "album", 2),
    text("xmpdm", "artist", 7),
    integer("xmpdm", "tracknumber", 20),
    texts("xmpdm", "genre", 92),
    date("xmpdm", "releasedate", 45),
    text("tika", "albumartist", 3),
    text("tika", "album artist", 3),
    text("xmpdm", "albumartist", 3),
    integer("tika", "totaltracks", 19),
    integer("tika", "tracktotal", 19),
    integer("tika", "discnumber", 87),
    integer("tika", "disc", 87),
    integer("tika", "totaldiscs", 108),
    integer("tika", "disctotal", 108),
    integer("tika", "originalyear", 77),
    text("tika", "composer", 12),
    text("xmpdm", "composer", 12),
    text("tika", "lyrics", 15),
    text("tika", "label", 93),
    text("tika", "copyright", 42),
    text("tika", "script", 64),
    text("tika", "releasecountry", 60),
    text("tika", "releasestatus", 62),
    text("tika", "releasetype", 63),
    text("tika", "catalognumber", 35),
    text("tika", "barcode", 34),
    text("tika", "asin", 33),
    text("tika", "musicbrainz_albumid", 96),
    text("tika", "musicbrainz_artistid", 97),
    text("tika", "musicbrainz_albumartistid", 95),
    text("tika", "musicbrainz_trackid", 100),
    text("tika", "musicbrainz_releasegroupid", 98),
    text("tika", "musicbrainz_releasetrackid", 99),
    text("tika", "acoustid_id", 1),
    float_("tika", "replaygain_track_gain", 22, coercer="number"),
    float_("tika", "replaygain_track_peak", 23, coercer="number"),
    float_("tika", "replaygain_album_gain", 5, coercer="number"),
    float_("tika", "replaygain_album_peak", 6, coercer="number"),
    float_("tika", "replaygain_reference_loudness", 17, coercer="number"),
    integer("tika", "samplerate", 18, coercer="integer_in_Frequency", low=8000.0, high=192000.0),
    integer("xmpdm", "audiosamplerate", 18, coercer="integer_in_Frequency", low=8000.0, high=192000.0),
    integer("tika", "channels", 11),
    integer("tika", "bits", 10),
    integer("flac", "samplerate", 18, coercer="integer_in_Frequency", low=8000.0, high=192000.0),
    integer("flac", "channels", 11),
    integer("flac", "bitspersample", 10),
    integer("tika", "bitrate", 84, coercer="integer_in_DataRate"),
    integer("composite", "avgbitrate", 84, coercer="integer_in_DataRate"),
    integer("quicktime", "audiobitrate", 84, coercer="integer_in_DataRate"),
    duration("xmpdm", "duration", 88),
    duration("tika", "duration", 88),
    duration("quicktime", "duration", 88),
    duration("composite", "duration", 88),
    float_("xmpdm", "videoframerate", 119, coercer="float_in_FrameRate", low=1.0, high=240.0),
    float_("quicktime", "videoframerate", 119, coercer="float_in_FrameRate", low=1.0, high=240.0),
    text("xmpdm", "audiocompressor", 85),
    text("xmpdm", "videocompressor", 85),
    text("quicktime", "compressorid", 85),
    text("tika", "artists", 7),
    text("tika", "artistsort", 8),
    text("tika", "albumartistsort", 4),
    text("tika", "grouping", 37),
    text("tika", "media", 94),
    date("tika", "originaldate", 44),
    text("tika", "musicbrainz_albumstatus", 62),
    text("tika", "musicbrainz_albumtype", 63),
    *each(TAG_NAMESPACES, text, "title", 73),
    *each(TAG_NAMESPACES, text, "artist", 7),
    *each(TAG_NAMESPACES, text, "artists", 7),
    *each(TAG_NAMESPACES, text, "album", 2),
    *each(TAG_NAMESPACES, text, "albumartist", 3),
    *each(TAG_NAMESPACES, text, "band", 3),
    *each(TAG_NAMESPACES, text, "composer", 12),
    *each(TAG_NAMESPACES, text, "artistsort", 8),
    *each(TAG_NAMESPACES, text, "albumartistsort", 4),
    *each(TAG_NAMESPACES, integer, "track", 20),
    *each(TAG_NAMESPACES, integer, "tracknumber", 20),
    *each(TAG_NAMESPACES, integer, "tracktotal", 19),
    *each(TAG_NAMESPACES, integer, "totaltracks", 19),
    *each(TAG_NAMESPACES, integer, "discnumber", 87),
    *each(TAG_NAMESPACES, integer, "disctotal", 108),
    *each(TAG_NAMESPACES, integer, "totaldiscs", 108),
    *each(TAG_NAMESPACES, integer, "year", 77),
    *each(TAG_NAMESPACES, integer, "originalyear", 77),
    *each(TAG_NAMESPACES, date, "date", 45),
    *each(TAG_NAMESPACES, date, "originaldate", 44),
    *each(TAG_NAMESPACES, text, "label", 93),
    *each(TAG_NAMESPACES, text, "barcode", 34),
    *each(TAG_NAMESPACES, text, "catalognumber", 35),
    *each(TAG_NAMESPACES, text, "asin", 33),
    *each(TAG_NAMESPACES, text, "media", 94),
    *each(TAG_NAMESPACES, text, "script", 64),
    *each(TAG_NAMESPACES, text, "releasestatus", 62),
    *each(TAG_NAMESPACES, text, "releasetype", 63),
    *each(TAG_NAMESPACES, text, "releasecountry", 60),
    *each(TAG_NAMESPACES, text, "organization", 57),
    *each(TAG_NAMESPACES, text, "grouping", 37),
    *each(TAG_NAMESPACES, text, "musicbrainzalbumid", 96),
    *each(TAG_NAMESPACES, text, "musicbrainzartistid", 97),
    *each(TAG_NAMESPACES, text, "musicbrainzalbumartistid", 95),
    *each(TAG_NAMESPACES, text, "musicbrainztrackid", 100),
    *each(TAG_NAMESPACES, text, "musicbrainzreleasegroupid", 98),
    *each(TAG_NAMESPACES, text, "musicbrainzreleasetrackid", 99),
    *each(TAG_NAMESPACES, text, "acoustidid", 1),
    *each(TAG_NAMESPACES, float_, "replaygaintrackgain", 22, coercer="number"),
    *each(TAG_NAMESPACES, float_, "replaygaintrackpeak", 23, coercer="number"),
    *each(TAG_NAMESPACES, float_, "replaygainalbumgain", 5, coercer="number"),
    *each(TAG_NAMESPACES, float_, "replaygainalbumpeak", 6, coercer="number"),
    texts("vorbis", "genre", 92),
    text("dc", "creator", 76),
    text("tika", "publisher", 59),
    text("machine", "platform", 116),
    text("machine", "machinetype", 110),
    text("exe", "productname", 58),
    text("exe", "companyname", 59),
    text("exe", "filedescription", 46),
    text("exe", "legalcopyright", 42),
    text("exe", "fileversion", 109),
    text("exe", "productversion", 109),
    text("exe", "machinetype", 110, coercer="pe_machine"),
]


def rules() -> list[Rule]:
    """All rules; of several for one namespace and key the last stands."""
    return list({(r.namespace, r.key): r for r in RULES}.values())
