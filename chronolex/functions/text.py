"""Scalar text functions as column expressions. Lengths count code points; null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges, word lists and signs that results depend on.
DENSE = r"　-〿぀-ヿ㐀-䶿一-鿿豈-﫿＀-｠｡-ﾟ"
SENTENCE_ENDERS = ".!?…。！？"
CLAUSE_ENDERS = ",;:—、，；："
FILLERS = (
    "ご視聴ありがとうございました",
    "ご視聴ありがとうございます",
    "最後までご視聴いただきありがとうございました",
    "チャンネル登録をお願いします",
    "チャンネル登録よろしくお願いします",
    "おやすみなさい",
    "本日はご覧いただきありがとうございます",
    "thankyouforwatching",
    "thanksforwatching",
    "thankyousomuchforwatching",
    "pleasesubscribetomychannel",
    "subscribetomychannel",
    "seeyouinthenextvideo",
    "obrigadoporassistir",
    "eaí",
    "graciasporver",
)
# Signs that close a draft, and hesitations that a translation should not begin with.
CLOSING = r"。？！、…,.?!;:」』)"
LEADING_HESITATION = r"(?i)^(hum+|uh+|hã+|ah+|bem|é+)\b[,.…]"
SCRIPTS = {
    "latin": r"A-Za-zÀ-ɏḀ-ỿＡ-Ｚａ-ｚ",
    "cyrillic": r"Ѐ-ԯ",
    "arabic": r"؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿",
    "devanagari": r"ऀ-ॿ",
    "thai": r"฀-๿",
    "hangul": r"ᄀ-ᇿ㄰-㆏가-힯",
    "kana": r"぀-ヿㇰ-ㇿｦ-ﾟ",
    "han": r"㐀-䶿一-鿿豈-﫿",
}
ACCEPTED = {"ja": ("kana", "han"), "zh": ("han",), "ko": ("hangul", "han"), "ru": ("cyrillic",), "uk": ("cyrillic",), "ar": ("arabic",), "hi": ("devanagari",), "th": ("thai",)}
TYPOGRAPHY = {
    "‘": "'", "’": "'", "‚": "'", "′": "'",
    "“": '"', "”": '"', "„": '"', "″": '"',
    "–": "-", "—": "-", "…": "...", " ": " ",
}
HESITATION_EN = r"(?i)(?:^|(?<=[\s,.!?]))(?:u+h+m*|u+m+|e+r+m+|h+m+)[,.]?(?=\s|$)\s*"
HESITATION_EN_COMMAS = r"(?i),\s+(?:u+h+m*|u+m+|e+r+m+|h+m+),(?=\s)"
HESITATION_JA = r"(?:(?<!ま[あぁ])ま[あぁ]ー*(?!ま[あぁ])|えー+っ?と?|えっと|ええっ?と|うー+ん|んー+|あの[ーぉ]+|あの(?=[、。？！ 　]|$|ま[あぁ]|えー|えっと|うーん))"


def is_dense(c: Column) -> Column:
    """Whether the first character belongs to a script that is written without spaces."""
    return c.rlike(f"^[{DENSE}]")


def has_dense(c: Column) -> Column:
    return c.rlike(f"[{DENSE}]")


def has_dense_letter(c: Column) -> Column:
    """Whether there is a letter of a script without spaces; wide signs alone do not count."""
    return c.rlike(rf"[{DENSE}&&[\p{{L}}]]")


def split_tokens(c: Column) -> Column:
    """Words at spaces; in texts with dense letters, each dense character is a token of its own."""
    dense = F.regexp_extract_all(c, F.lit(rf"[{DENSE}&&[^\s\u3000]]|[^\s{DENSE}]+"), F.lit(0))
    return F.when(has_dense_letter(c), dense).otherwise(F.filter(F.split(c, " "), lambda x: x != ""))


#: A sign that stands between tokens while they are joined; tokens that hold it themselves are joined one by one.
SEAM = "\x01"


def join_tokens(tokens: Column) -> Column:
    """Tokens with a space between each two, but not beside a dense letter or white space if the tokens have dense letters;
    after an empty token there is none more. Seams are looked at in one pass, so long texts take time in proportion."""
    joined = F.array_join(tokens, SEAM)
    seams = F.replace(F.regexp_replace(joined, rf"(?<=[{DENSE}\s{SEAM}]|^){SEAM}|{SEAM}(?=[{DENSE}\s])", ""), F.lit(SEAM), F.lit(" "))
    edge = lambda x: x.rlike(rf"[{DENSE}\s]$")
    start = lambda x: x.rlike(rf"^[{DENSE}\s]")
    follow = lambda before, x: F.concat(F.when((before == "") | edge(before) | start(x), F.lit("")).otherwise(F.lit(" ")), x)
    one_by_one = F.array_join(F.zip_with(F.concat(F.array(F.lit("")), tokens), tokens, follow), "")
    dense = F.when(F.exists(tokens, lambda x: x.isNull()), F.lit(None)).when(F.contains(F.array_join(tokens, ""), F.lit(SEAM)), one_by_one).otherwise(seams)
    return F.when(has_dense_letter(joined), dense).otherwise(F.array_join(tokens, " "))


def tighten_dense(c: Column) -> Column:
    """Single spaces between dense letters removed; longer runs stay."""
    return F.regexp_replace(c, rf"(?<=[{DENSE}]) (?=[{DENSE}])", "")


def normalize(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def has_content(c: Column) -> Column:
    return c.rlike(r"[\p{L}\p{N}]")


def tidy(c: Column) -> Column:
    """Trimmed, without leading signs other than inverted question and exclamation marks."""
    return F.trim(F.regexp_replace(F.trim(c), r"^[^\p{L}\p{N}¿¡]+", ""))


def line_width(language: Column) -> Column:
    return F.when(language.isin("ja", "zh"), 20).otherwise(42)


def overlap_trim(previous: Column, new: Column, most: int = 8) -> Column:
    """new without the longest prefix of at most `most` words that ends previous; words are compared normalised."""
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda x: x != "")
    a, b = words(previous), words(new)
    na, nb = F.transform(a, normalize), F.transform(b, normalize)

    def same(k):
        tail, head = F.slice(na, F.greatest(F.size(na) - k + 1, F.lit(1)), k), F.slice(nb, 1, k)
        return (F.size(na) >= k) & (F.size(nb) >= k) & (tail == head) & ~F.array_contains(head, "")

    hit = F.coalesce(F.get(F.filter(F.array(*[F.lit(k) for k in range(most, 0, -1)]), same), F.lit(0)), F.lit(0))
    return F.array_join(F.slice(b, hit + 1, F.greatest(F.size(b), F.lit(1))), " ")


def is_filler(c: Column) -> Column:
    """No letter or digit, or nothing but one of the known phrases, repeated up to three times."""
    return normalize(c).rlike(f"^(?:|{'|'.join(f'(?:{x}){{1,3}}' for x in FILLERS)})$")


def strip_special(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"<\|[^|]*\|>", ""))


def is_real_speech(no_speech: Column, logprob: Column, compression: Column) -> Column:
    return (no_speech < 0.6) & (logprob > -1.0) & (compression < 2.4)


def is_written(c: Column, language: Column) -> Column:
    """Whether more of the letters of known scripts are of the language's scripts than not."""
    inside = lambda names: F.regexp_count(c, F.lit(f"[{''.join(SCRIPTS[n] for n in names)}&&[\\p{{IsAlphabetic}}]]"))
    own = inside(("latin",))
    for code, names in ACCEPTED.items():
        own = F.when(language == code, inside(names)).otherwise(own)
    return 2 * own > inside(tuple(SCRIPTS))


def plain_typography(c: Column) -> Column:
    for a, b in TYPOGRAPHY.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_hesitations_en(c: Column) -> Column:
    """Without um, uh, erm, hmm; a capital that goes with one passes to the next word."""
    cut = F.regexp_replace(F.regexp_replace(c, HESITATION_EN_COMMAS, ""), HESITATION_EN, "")
    out = F.regexp_replace(F.trim(F.replace(F.replace(cut, F.lit("  "), F.lit(" ")), F.lit(" ,"), F.lit(","))), r"^(?:,\s*)+", "")
    capital = c.rlike(r"^\p{Lu}") & out.rlike(r"^\p{Ll}")
    out = F.when(capital, F.concat(F.upper(F.substring(out, 1, 1)), F.substr(out, F.lit(2)))).otherwise(out)
    return F.when(cut == c, c).otherwise(out)


def strip_hesitations_ja(c: Column) -> Column:
    cut = F.regexp_replace(c, rf"{HESITATION_JA}[、 \u3000]?", "")
    out = F.regexp_replace(F.regexp_replace(cut, "、+(?=[、。？！])", ""), r"^[、 \u3000]+", "")
    return F.when(cut == c, c).otherwise(out)


def same_text(a: Column, b: Column, tolerance: float = 0.25) -> Column:
    """Edit distance over the longer length of the normalised texts is at most tolerance; empty equals only empty."""
    a, b = normalize(a), normalize(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), a == b).otherwise(F.levenshtein(a, b) <= tolerance * longest)


def too_short(c: Column) -> Column:
    return (F.length(c) < 4) & ~c.rlike(r"\s")


def is_newer(remote: Column, local: Column) -> Column:
    """Versions of any number of parts by number; missing parts are 0, a leading v is ignored."""
    parts = lambda c: F.transform(F.split(F.regexp_replace(c, "^[vV]", ""), r"\."), lambda x: F.coalesce(x.try_cast("long"), F.lit(0).cast("long")))
    a, b = parts(remote), parts(local)
    n = F.greatest(F.size(a), F.size(b))
    padded = lambda x: F.concat(x, F.array_repeat(F.lit(0).cast("long"), n - F.size(x)))
    return padded(a) > padded(b)


def clock(seconds: Column) -> Column:
    s = F.floor(F.when(seconds > 0, seconds).when(seconds.isNotNull(), 0)).cast("long")
    hours, minutes, rest = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    long = F.format_string("%d:%02d:%02d", hours, minutes, rest)
    return F.when(hours > 0, long).when(hours.isNotNull(), F.format_string("%d:%02d", minutes, rest))


def timecode(seconds: Column) -> Column:
    """HH:MM:SS,mmm; rounded to milliseconds once."""
    ms = F.round(F.when(seconds > 0, seconds).when(seconds.isNotNull(), 0.0) * 1000).cast("long")
    return F.when(ms.isNotNull(), F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000))


def parse_timecode(c: Column) -> Column:
    """Seconds of H:M:S[,.]ms; null unless there are three parts in their ranges."""
    parts = F.split(F.replace(F.trim(c), F.lit(","), F.lit(".")), ":")
    part = lambda i: F.trim(F.get(parts, F.lit(i))).try_cast("double")
    h, m, s = part(0), part(1), part(2)
    good = (F.size(parts) == 3) & (h >= 0) & (h < 1e6) & (m >= 0) & (m < 60) & (s >= 0) & (s < 60)
    return F.when(good, h * 3600 + m * 60 + s)


# The colours of speakers 1 to 4.
PALETTE = ("#FFFFFF", "#FFFF54", "#54FFFF", "#54FF54")


def palette_index(label: Column, colours: int = 4) -> Column:
    n = F.regexp_replace(label, "[^0-9]", "").try_cast("int")
    return F.when(n.isNotNull(), F.greatest(n - 1, F.lit(0)) % colours)


def estimate(seconds: Column) -> Column:
    return F.when(seconds < 90, F.concat(F.lit("≈ "), F.round(seconds).cast("int").cast("string"), F.lit(" s"))).otherwise(F.concat(F.lit("≈ "), F.round(seconds / 60).cast("int").cast("string"), F.lit(" min")))


def container(content: Column) -> Column:
    """The container of a file by its first bytes; null if they say nothing or are fewer than 12."""
    h = F.hex(F.substring(content, 1, 256))
    at = lambda i, magic: F.substring(h, 2 * i + 1, len(magic)) == magic
    text = lambda i, word: at(i, word.encode().hex().upper())
    found = (
        F.when(text(4, "ftypqt "), "MOV").when(text(4, "ftypM4A"), "M4A").when(text(4, "ftypM4V"), "M4V").when(text(4, "ftyp"), "MP4")
        .when(text(0, "RIFF") & text(8, "WAVE"), "WAV").when(text(0, "RIFF") & text(8, "AVI "), "AVI").when(text(0, "RIFF"), "RIFF")
        .when(text(0, "FORM") & (text(8, "AIFF") | text(8, "AIFC")), "AIFF").when(text(0, "caff"), "CAF").when(text(0, "fLaC"), "FLAC")
        .when(text(0, "OggS"), "Ogg").when(text(0, "ID3"), "MP3")
        .when(at(0, "1A45DFA3") & h.rlike("^(?:..)*7765626D"), "WebM").when(at(0, "1A45DFA3"), "MKV").when(at(0, "3026B275"), "ASF/WMV")
        .when(at(0, "47") & (F.length(content) > 188) & at(188, "47"), "MPEG-TS").when(h.rlike("^FF[EF]"), "MP3")
    )
    return F.when(F.length(content) >= 12, found)


def is_confirmed(text: Column, confirmation: Column) -> Column:
    """Whether the normalised confirmation holds the normalised text, which must not be empty."""
    plain = normalize(text)
    return (plain != "") & F.contains(normalize(confirmation), plain)


def strip_hesitations(c: Column, language: Column) -> Column:
    """By the language's rules, English or Japanese; other languages stay; null where nothing with content is left."""
    out = F.when(language == "en", strip_hesitations_en(c)).when(language == "ja", strip_hesitations_ja(c)).otherwise(c)
    return F.when(has_content(out), out)


def prompt(lines: Column) -> Column:
    """An array of lines, numbered from 1: `1) first`, one a line."""
    return F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(") "), x)), "\n")


def split_paragraph(paragraphs: Column, expected: Column) -> Column:
    """One paragraph whose lines are as many as expected becomes those lines; anything else stays."""
    lines = F.split(F.get(paragraphs, F.lit(0)), "\n")
    return F.when((F.size(paragraphs) == 1) & (expected > 1) & (F.size(lines) == expected), lines).otherwise(paragraphs)


def acceptable(result: Column, ready: Column, seen_working: Column, previous: Column) -> Column:
    """A reading counts if the page is ready and was seen working, or has no predecessor, or differs from it."""
    return ready & (seen_working | previous.isNull() | ~result.eqNullSafe(previous))


def same_lines(a: Column, b: Column) -> Column:
    """Whether two arrays of lines say the same but for white space."""
    plain = lambda c: F.regexp_replace(F.array_join(c, ""), r"\s", "")
    return plain(a) == plain(b)


def process_group(bundle: Column, executable: Column, pid: Column) -> Column:
    """The bundle without its parts from the first one that begins with helper; else the executable, else the process."""
    parts = F.filter(F.split(bundle, r"\."), lambda x: x != "")
    helper = F.array_position(F.transform(parts, lambda x: F.lower(x).startswith("helper")), True)
    kept = F.array_join(F.when(helper > 0, F.slice(parts, F.lit(1), (helper - 1).cast("int"))).otherwise(parts), ".")
    other = F.coalesce(F.concat(F.lit("exec:"), executable), F.concat(F.lit("pid:"), pid.cast("string")))
    return F.when(F.coalesce(bundle, F.lit("")) == "", other).when(kept == "", bundle).otherwise(kept)


def progress_pass(progress: Column) -> Column:
    """(number, fraction) of the pass that a progress of 0, 1, 2 ... is in; a whole number is the end of its pass."""
    whole = F.greatest(F.floor(progress), F.lit(0)).cast("int")
    ends = (whole > 0) & (progress == whole)
    fraction = F.least(F.greatest(progress - whole, F.lit(0.0)), F.lit(1.0))
    return F.struct(F.when(ends, whole).otherwise(whole + 1).alias("number"), F.when(ends, 1.0).otherwise(fraction).alias("fraction"))


# The share of the whole that each step takes.
STEP_SHARES = {"extracting": (0.00, 0.04), "loadingASR": (0.04, 0.12), "diarizing": (0.12, 0.18), "transcribing": (0.18, 0.48), "loadingTranslator": (0.48, 0.52), "translating": (0.52, 0.97), "saving": (0.97, 1.00), "readingImage": (0.00, 1.00)}
# Seconds of work per second of video.
COSTS = {"deepl": 0.12, "hunyuan": 0.18, "google": 0.01, "gemini": 0.08, "transcriptionOnly": 0.05, "apple": 0.1}


def overall_progress(step: Column, within: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, (low, high) in STEP_SHARES.items():
        out = F.when(step == name, F.lit(low) + F.lit(high - low) * within).otherwise(out)
    return out


def cost(engine: Column) -> Column:
    """Seconds of work per second of video; null for an unknown engine."""
    out = F.lit(None).cast("double")
    for name, value in COSTS.items():
        out = F.when(engine == name, value).otherwise(out)
    return out


# The containers that can be opened.
SUPPORTED = ("MP4", "M4V", "M4A", "MOV", "MP3", "WAV", "AIFF", "AAC", "CAF", "FLAC")


def is_supported(name: Column) -> Column:
    return F.coalesce(name.isin(*SUPPORTED), F.lit(False))


def suggested_name(at: Column, prefix: str = "capture-") -> Column:
    return F.concat(F.lit(prefix), F.date_format(at, "yyyy-MM-dd-HHmm"), F.lit(".txt"))


def suggested_srt_name(path: Column, language: Column) -> Column:
    """The file's name without its last extension, the language and .srt; `subtitles` where there is no file."""
    base = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.concat(F.when(F.coalesce(base, F.lit("")) == "", F.lit("subtitles")).otherwise(base), F.lit("."), language, F.lit(".srt"))


def url_bytes(c: Column) -> Column:
    """UTF-8 bytes of a text after percent-encoding: ASCII letters and digits take one, other bytes three each."""
    kept = F.length(F.regexp_replace(c, r"[^A-Za-z0-9]", ""))
    return 3 * (F.octet_length(c) - kept) + kept


def percent_encoded(c: Column) -> Column:
    """Every UTF-8 byte but ASCII letters and digits as % and two hex digits."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for kept in ".*_-":
        out = F.replace(out, F.lit(kept), F.lit(f"%{ord(kept):02X}"))
    return out


#: Characters that a script's literal cannot hold, and how they are written.
SCRIPT_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r"} | {chr(c): f"\\u{c:04x}" for c in (*(c for c in range(1, 32) if c not in (10, 13)), 0x2028, 0x2029)}


def script_literal(c: Column) -> Column:
    """A text as a literal of a script, in double quotes."""
    for char, written in SCRIPT_ESCAPES.items():
        c = F.replace(c, F.lit(char), F.lit(written))
    return F.concat(F.lit('"'), c, F.lit('"'))


def request_address(lines: Column, source: Column, target: Column, nonce: Column, base: str) -> Column:
    """base with the nonce as a query and both codes and the lines as a fragment; null where a code is."""
    return F.concat(F.lit(f"{base}?bloco="), nonce.cast("string"), F.lit("#"), source, F.lit("/"), target, F.lit("/"), percent_encoded(F.array_join(lines, "\n")))
