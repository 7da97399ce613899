"""Classes of files, folders and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.coerce import mime as mime_essence
from shelfmark.functions.paths import extension, stem

# Extensions, names and patterns that decide a file's class and role.
VIDEO_EXTENSIONS = ".mkv .mp4 .avi .mov .m4v .webm .wmv .flv .mpg .mpeg .m2ts .mts .ts .vob .ogv .3gp .divx .rm .rmvb .asf".split()
AUDIO_EXTENSIONS = ".flac .mp3 .m4a .aac .ogg .oga .opus .wav .wma .alac .ape .wv".split()
IMAGE_EXTENSIONS = ".jpg .jpeg .png .gif .bmp .webp .tiff .tif".split()
EXECUTABLE_EXTENSIONS = ".exe .msi .com".split()
ART_STEMS = "cover folder backdrop logo poster fanart banner front back thumb thumbnail albumart albumartsmall disc".split()
SUBTITLE_EXTENSIONS = ".srt .sub .idx .ass .ssa .vtt .smi .sami .sup .ttml".split()
RESOURCE_EXTENSIONS = ".dll .so .dylib .ocx .sys .drv .vxd .cpl .lib .a .o .vol .ani .pak .wad .dat .bin .res .pk3 .pk4 .bsp .mdl .spr .vdf .gcf .big .bsa .cab .inf .isu .ini .cfg .conf".split()
AUXILIARY_STEMS = "setup install installer autorun uninstall uninst unins000 unwise rar winrar unrar 7z 7za 7zfm vcredist dxsetup dotnetfx oalinst directx dxwebsetup redist update patch".split()
NOISE_TOKENS = (
    "1080p 720p 480p 2160p 4k uhd hd sd bluray blu ray bdrip brrip webrip web dl hdtv dvdrip dvd remux x264 x265 h264 h265 hevc avc "
    "xvid divx aac ac3 dts dd ddp mp3 flac atmos truehd 10bit 8bit hdr sdr dubbed subbed rodubbed rosub multi dual audio proper repack "
    "extended remastered unrated internal limited complete yify rip"
).split()
DISC_RIP_EXTENSIONS = ".vob .ifo .bup .m2ts .bdmv".split()
GENERIC_NAME = r"(?i)^(movie|video|film|main|title|playlist|index|stream|default|fullmovie|full|dvd|disc|cd|part|vts[\s._-]*\d+|title[\s._-]*\d+|disc[\s._-]*\d+|cd[\s._-]*\d+|part[\s._-]*\d+|\d+)$"
STRUCTURAL_NAME = r"(?i)^(season|series|saison|book|vol|volume|disc|disk|cd|part|pt|s)[\s._-]*\d+$|^(specials?|extras?|bonus)$"
SEASON_NAME = r"(?i)^(season|series|saison|s)[\s._-]*\d+$|^(specials?|extras)$"
SEASON_FOLDER = r"(?i)^(?:season|series|saison|temporada|staffel|sezon(?:ul)?|s|specials?)[ ._-]*\d*$"
ARCHIVE_NAME = r"(?i)\.(zip|cbz|tar|tgz|tbz|tbz2|txz|7z|cb7|rar|cbr)$|\.tar\.(gz|bz2|xz)$"
GENERIC_MIMES = ["application/octet-stream", "binary/octet-stream", "application/x-binary", "application/unknown", "content/unknown", "*/*"]
# Label (and class) of a subtype, by type.
LABELS = {
    "audio": ([("x-flac flac", "FLAC audio"), ("mp3 mpeg mpeg3 x-mpeg-3", "MP3 audio"), ("mp4 x-m4a aac", "AAC audio"), ("ogg x-vorbis+ogg", "Ogg audio"), ("x-wav wav vnd.wave", "WAV audio"), ("opus", "Opus audio")], "Audio"),
    "video": ([("mp4", "MP4 video"), ("x-matroska", "Matroska video"), ("x-msvideo", "AVI video"), ("quicktime", "QuickTime video"), ("webm", "WebM video"), ("x-ms-wmv", "Windows Media video")], "Video"),
    "image": ([("jpeg jpg pjpeg", "JPEG image"), ("png", "PNG image"), ("gif", "GIF image"), ("bmp x-ms-bmp", "Bitmap image"), ("webp", "WebP image"), ("tiff", "TIFF image"), ("svg+xml", "SVG image")], "Image"),
    "text": ([("plain", "Text document"), ("html xhtml", "HTML document"), ("x-nfo x-nfo+ascii", "NFO file"), ("markdown x-markdown", "Markdown document"), ("csv", "CSV file")], "Text"),
}
APPLICATIONS = [
    ("pdf", "Document", "PDF document"),
    ("msword vnd.openxmlformats-officedocument.wordprocessingml.document vnd.oasis.opendocument.text rtf x-rtf", "Document", "Word document"),
    ("vnd.ms-excel vnd.openxmlformats-officedocument.spreadsheetml.sheet vnd.oasis.opendocument.spreadsheet", "Document", "Spreadsheet"),
    ("vnd.ms-powerpoint vnd.openxmlformats-officedocument.presentationml.presentation vnd.oasis.opendocument.presentation", "Document", "Presentation"),
    ("epub+zip x-mobipocket-ebook oebps-package+xml vnd.amazon.ebook x-fictionbook+xml", "Document", "E-book"),
    ("x-msdownload x-dosexec vnd.microsoft.portable-executable x-executable x-msi x-ms-installer", "Software", "Windows executable"),
    ("x-msdos-program x-ms-shortcut", "Software", "Windows program"),
    ("winhlp x-winhelp", "Document", "Windows help"),
    ("zip x-rar x-rar-compressed x-7z-compressed x-tar gzip x-gzip x-bzip2 x-zip-compressed", "Archive", "Archive"),
]
CLASS_OF_TYPE = {"audio": "Audio", "video": "Video", "image": "Image", "text": "Document"}


def is_archive(name: Column) -> Column:
    return name.rlike(ARCHIVE_NAME)


def _by_mime_or_name(name: Column, mime: Column, prefix: str, extensions: list[str]) -> Column:
    has_mime = F.coalesce(mime, F.lit("")) != ""
    return F.when(has_mime, F.lower(mime).startswith(prefix)).otherwise(extension(name).isin(*extensions))


def is_image(name: Column, mime: Column) -> Column:
    return _by_mime_or_name(name, mime, "image/", IMAGE_EXTENSIONS)


def is_audio(name: Column, mime: Column) -> Column:
    return _by_mime_or_name(name, mime, "audio/", AUDIO_EXTENSIONS)


def is_video(name: Column, mime: Column) -> Column:
    return _by_mime_or_name(name, mime, "video/", VIDEO_EXTENSIONS)


def is_executable(name: Column) -> Column:
    return extension(name).isin(*EXECUTABLE_EXTENSIONS)


def is_primary_media(name: Column, mime: Column) -> Column:
    return is_audio(name, mime) | is_video(name, mime) | is_executable(name)


def is_auxiliary_executable(name: Column) -> Column:
    return is_executable(name) & (stem(name).isin(*AUXILIARY_STEMS) | stem(name).startswith("unins"))


def sidecar_kind(name: Column, mime: Column) -> Column:
    ext = extension(name)
    return (
        F.when(F.lower(name).endswith(".info.json"), "CompanionResource")
        .when(ext == ".opf", "Opf")
        .when(ext == ".lrc", "Lrc")
        .when(ext == ".nfo", "Nfo")
        .when(is_image(name, mime) & stem(name).isin(*ART_STEMS), "CompanionArt")
        .when(ext.isin(*SUBTITLE_EXTENSIONS, *RESOURCE_EXTENSIONS), "CompanionResource")
        .otherwise("Content")
    )


def is_structural_name(name: Column) -> Column:
    return F.trim(name).rlike(STRUCTURAL_NAME)


def is_season_name(name: Column) -> Column:
    return F.trim(name).rlike(SEASON_NAME)


def title_tokens(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), r"[^\p{L}\p{N}]+", -1), lambda t: (t != "") & ~t.isin(*NOISE_TOKENS) & ~t.rlike(r"^\d{4}$"))


def folder_is_dedicated(folder: Column, primary: Column, files: Column) -> Column:
    """Whether a folder is about its one item: it rips a disc, or the names tell of the same title."""
    base = F.regexp_replace(primary, r"\.[^./\\]*$", "")
    of_file, of_folder = title_tokens(base), title_tokens(folder)
    hits = F.size(F.filter(of_folder, lambda t: F.array_contains(of_file, t)))
    rip = F.exists(files, lambda f: extension(f).isin(*DISC_RIP_EXTENSIONS))
    return (
        F.when(rip, True)
        .when(F.trim(base).rlike(GENERIC_NAME) | (F.size(of_file) == 0), True)
        .when(F.size(of_folder) == 0, False)
        .otherwise(hits >= F.ceil(F.lit(0.6) * F.size(of_file)))
    )


def best_mime(file_mime: Column, parser_mime: Column) -> Column:
    """The more specific of two content types, the parser's first."""
    f, p = F.lower(mime_essence(file_mime)), F.lower(mime_essence(parser_mime))
    return F.when(p.isNotNull() & ~p.isin(*GENERIC_MIMES), p).when(f.isNotNull() & ~f.isin(*GENERIC_MIMES), f).otherwise(F.coalesce(p, f))


def _titleized(sub: Column) -> Column:
    # What follows the first dash; without one nothing is cut, which keeps "vnd".
    cut = F.when(sub.startswith("x-") | sub.startswith("vnd."), F.regexp_replace(sub, r"^[^-]*-", "")).otherwise(sub)
    words = F.trim(F.regexp_replace(cut, r"[-.+]", " "))
    return F.when(words == "", "Other").otherwise(F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, F.lit(2), F.length(words))))


def _split(mime: Column) -> tuple[Column, Column]:
    return F.substring_index(mime, "/", 1), F.when(F.contains(mime, F.lit("/")), F.regexp_replace(mime, "^[^/]*/", "")).otherwise("")


def media_class(mime: Column) -> Column:
    """Class of a reconciled content type."""
    kind, sub = _split(mime)
    out = F.when(mime.isNull() | mime.isin(*GENERIC_MIMES), "Other").when(mime == "inode/directory", "Folder")
    for name, of in CLASS_OF_TYPE.items():
        out = out.when(kind == name, of)
    for subs, of, _ in APPLICATIONS:
        out = out.when((kind == "application") & sub.isin(*subs.split()), of)
    return out.when((kind == "application") & sub.isin("json", "xml", "x-yaml"), "Document").otherwise("Other")


def media_label(mime: Column) -> Column:
    kind, sub = _split(mime)
    out = F.when(mime.isNull() | mime.isin(*GENERIC_MIMES), "Unknown").when(mime == "inode/directory", "Folder")
    for name, (labels, rest) in LABELS.items():
        for subs, label in labels:
            out = out.when((kind == name) & sub.isin(*subs.split()), label)
        out = out.when(kind == name, rest)
    for subs, _, label in APPLICATIONS:
        out = out.when((kind == "application") & sub.isin(*subs.split()), label)
    return out.otherwise(_titleized(sub))


# How a season and an episode are written, the tag at a name's end, the year of a show, and what separates parts of a name.
EPISODE_CODES = (r"\b[Ss](\d{1,4})[ ._]?[Ee](\d{1,6})(?:-\d{1,6})?\b", r"\b(\d{1,2})x(\d{1,4})\b")
END_TAG, SHOW_YEAR = r"\s*[\[(][^\])]*[\])]\s*$", r"\s*\((?:19|20)\d{2}\)\s*$"
SEPARATORS = " \t._-–—"


def _spaced(part: Column) -> Column:
    """Dots and underscores read as spaces, in a part of a name that has no spaces."""
    return F.when(F.contains(part, F.lit(" ")), part).otherwise(F.trim(F.regexp_replace(part, r"[._]+", " ")))


def tv_episode(name: Column, folder: Column, parent: Column) -> Column:
    """(series, season, episode, title) of a file name without extension; null if it names none.

    The first code in the name tells season and episode; what stands before it is
    the series, what follows the title. Without the former the folder gives the
    series, or the one above if the folder is a season's.
    """
    show = F.trim(F.coalesce(F.when(F.trim(folder).rlike(SEASON_FOLDER), parent).otherwise(folder), F.lit("")))
    both = F.struct(F.trim(F.regexp_replace(name, END_TAG, "")).alias("base"), _spaced(F.trim(F.regexp_replace(show, SHOW_YEAR, ""))).alias("show"))

    def parsed(code: str, x: Column) -> Column:
        """What the first place of a code tells; that place is looked for once."""

        def one(m: Column) -> Column:
            at, whole = m["at"], m["whole"]
            before = _spaced(F.btrim(F.substring(x["base"], F.lit(1), at - 1), F.lit(SEPARATORS)))
            after = _spaced(F.btrim(F.substring(x["base"], at + F.length(whole), F.length(x["base"])), F.lit(SEPARATORS)))
            number = lambda i: F.regexp_extract(whole, code, i).try_cast("int")
            told = F.struct(F.when(before == "", x["show"]).otherwise(before).alias("series"), number(1).alias("season"), number(2).alias("episode"), F.nullif(after, F.lit("")).alias("title"))
            return F.when(at > 0, told)

        place = F.struct(F.regexp_instr(x["base"], F.lit(code)).alias("at"), F.regexp_extract(x["base"], code, 0).alias("whole"))
        return F.get(F.transform(F.array(place), one), 0)

    # Functions of arrays of one bind a value to a name, so that it is told once, however often it is used.
    return F.get(F.transform(F.array(both), lambda x: F.coalesce(*[parsed(code, x) for code in EPISODE_CODES])), 0)
