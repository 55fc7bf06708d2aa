"""Normalisation of Japanese registry and drawing texts as column expressions.

Null reads as the empty text. Everything runs inside Spark's expressions.
"""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
CODED = {
    "<00008328>": "茨", "<00009AD9>": "髙", "<0000FA11>": "﨑", "<0000FA19>": "神", "<0000F9DC>": "隆",
    "<00005BEC>": "寬", "<00005EE3>": "廣", "<000080D6>": "胖", "<00008FC4>": "迄", "<000049FA>": "䧺",
    "<0000E452>": "〓", "<00100F20>": "〓", "<000F61BE>": "〓",
}
OLD_FORMS = "﨑髙藏惠鐵廣寬眞實彌經濱澤邊齋齊國嶋條學萬壽榮禮顯黑靜關"
NEW_FORMS = "崎高蔵恵鉄広寛真実弥経浜沢辺斎斉国島条学万寿栄礼顕黒静関"
EMPTY_MARKERS = ("(空)", "（空）", "(空欄)", "（空欄）", "-", "―")
ADDRESS = "(都|道|府|県|市|区|町|村|郡|番地|丁目|番の|番地の|字|大字)"
LAND_USES = ("宅地", "山林", "雑種地", "公衆用道路", "田", "畑", "原野", "墓地", "境内地", "学校用地", "鉄道用地", "池沼", "牧場", "保安林", "ため池")
ERA_DATE, RECEIPT = "(明治|大正|昭和|平成|令和)(?U)\\d+年", "第(?U)\\d+号"
PUBLIC_LAND = "^(県道|河川|市道|国道|水|道)-"


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def width_fold(c: Column) -> Column:
    """Full-width ASCII and the ideographic space as ASCII: a part of NFKC that needs less work."""
    return F.translate(text(c), WIDE, NARROW)


def _ranges(chars: str) -> str:
    """A regular expression's class of these characters, as ranges: a class of single ones is slow to match."""
    codes = sorted(map(ord, set(chars)))
    starts = [c for i, c in enumerate(codes) if i == 0 or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i == len(codes) - 1 or codes[i + 1] != c + 1]
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True)) + "]"


def _once(x: Column, change) -> Column:
    """change(x) with x evaluated a single time, as an array's lambda does."""
    return F.get(F.transform(F.array(x), change), F.lit(0))


def _compatible() -> tuple[str, str, dict[str, str], str, str]:
    """Characters with one character as their NFKC form, those forms, longer forms and compositions by text, a pattern for the latter, and one for all."""
    single, several = {}, {}
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x10000))):
        form = unicodedata.normalize("NFKC", c)
        if form != c:
            (single if len(form) == 1 else several)[c] = form
    pairs = {}
    for c in map(chr, range(0x80, 0xD800)):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", c) == c:
            pairs["".join(chr(int(p, 16)) for p in parts)] = c
    marks = "".join(sorted({p[1] for p in pairs}))
    # a composed letter takes one more mark
    return "".join(single), "".join(single.values()), several | pairs, f"{_ranges(''.join(several))}|(?s:.){_ranges(marks)}", _ranges("".join((*single, *several, *marks)))


_FROM, _TO, _FORMS, _PATTERN, _ANY = _compatible()


#: Characters that NFKC leaves alone, whatever stands beside them: ASCII, brackets, kana without marks, the common ideographs. Looked at first, since a class of
#: few ranges is fast to match.
_SAFE = "\\x{1}-\\x{7e}\\x{3001}-\\x{3029}\\x{3041}-\\x{3096}\\x{30a1}-\\x{30fa}\\x{30fc}\\x{4e00}-\\x{9fff}"
#: Those that normalize leaves alone too: without white space but the blank, and without the start of a code.
_PLAIN = "\\x{1}-\\x{8}\\x{e}-\\x{3b}\\x{3d}-\\x{7e}" + _SAFE.removeprefix("\\x{1}-\\x{7e}")


def nfkc(c: Column) -> Column:
    """Unicode NFKC of the basic plane, for letters with up to two marks; Hangul syllables have to be composed already."""
    forms = F.from_json(F.lit(json.dumps(_FORMS)), "map<string,string>")

    def composed(x: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(x, F.lit(_PATTERN), F.lit(0)))
        return F.aggregate(found, x, lambda acc, f: F.replace(acc, f, F.coalesce(F.try_element_at(forms, f), f)))

    def where_needed(v: Column, change) -> Column:
        return F.when(v.rlike(_PATTERN), change(v)).otherwise(v)

    full = _once(F.translate(text(c), _FROM, _TO), lambda v: where_needed(v, lambda w: _once(composed(w), lambda u: where_needed(u, composed))))
    return F.when(text(c).rlike(f"[^{_SAFE}]") & text(c).rlike(_ANY), full).otherwise(text(c))


def collapse(c: Column) -> Column:
    return _once(c, lambda v: F.when(v.rlike("(?U)\\s"), F.trim(F.regexp_replace(v, "(?U)\\s+", " "))).otherwise(v))


def decode_codes(c: Column) -> Column:
    """Codes like <00003042> as their character; codes without one, and surrogates, as a geta mark."""

    def one(acc: Column, code: Column) -> Column:
        up = F.upper(code)
        real = up.between("<00000001>", "<0010FFFF>") & ~up.between("<0000D800>", "<0000DFFF>")
        return F.replace(acc, code, F.when(real, F.decode(F.unhex(F.substring(code, 2, 8)), "UTF-32")).otherwise("〓"))

    def decoded(v: Column) -> Column:
        known = v
        for code, value in CODED.items():
            known = F.replace(known, F.lit(code), F.lit(value))
        return _once(known, lambda k: F.aggregate(F.array_distinct(F.regexp_extract_all(k, F.lit("<[0-9A-Fa-f]{8}>"), F.lit(0))), k, one))

    return _once(text(c), lambda v: F.when(v.contains("<"), decoded(v)).otherwise(v))


def normalize(c: Column, fold=nfkc) -> Column:
    """Folded, codes decoded, trimmed, white space collapsed."""
    # most texts are as they should be, which is cheap to see
    v = text(c)
    plain = v.rlike(f"^[{_PLAIN}]*+\\z") & ~v.contains("  ") & ~v.startswith(" ") & ~v.endswith(" ")
    return F.when(plain, v).otherwise(collapse(decode_codes(fold(c))))


def normalize_all(cells: Column) -> Column:
    """normalize of every cell of an array. One look at all of them together passes most lines by; the rest go cell by cell."""
    # cells between separators; a null shows as two blanks, as do ends and runs of blanks that normalize would change
    together = F.concat(F.lit("\u0001"), F.array_join(cells, "\u0001", "  "), F.lit("\u0001"))
    blanks = together.contains("  ") | together.contains("\u0001 ") | together.contains(" \u0001")
    # one class of few ranges; plain searches for the rest, since alternatives would be tried at every character
    return F.when(blanks | ~together.rlike(f"^[{_PLAIN}]*+\\z"), F.transform(cells, lambda x: normalize(x))).otherwise(cells)


def key_text(c: Column, fold=nfkc) -> Column:
    v = normalize(c, fold)
    return F.replace(v, F.lit(" "), F.lit(""))


def hyphens_as_branch(c: Column) -> Column:
    """A normalised parcel number with 番 for the hyphens between numbers."""
    return F.regexp_replace(F.translate(c, "－ー—", "---"), "(?U)(\\d+)-(\\d+)", "$1番$2")


def parcel_number(c: Column, fold=nfkc) -> Column:
    return hyphens_as_branch(normalize(c, fold))


def parcel_key(c: Column, fold=nfkc) -> Column:
    return F.regexp_replace(F.replace(parcel_number(c, fold), F.lit("番の"), F.lit("番")), "番$", "")


def area(c: Column, fold=width_fold) -> Column:
    dotted = F.translate(F.trim(fold(c)), "・‧･", "...")
    return F.when(dotted.contains("."), F.regexp_replace(F.regexp_replace(dotted, "0+$", ""), "\\.+$", "")).otherwise(dotted)


def name_key(c: Column, fold=nfkc) -> Column:
    return key_text(c, fold)


def old_form_fold(c: Column) -> Column:
    return F.replace(F.translate(text(c), OLD_FORMS, NEW_FORMS), F.lit("シヨ"), F.lit("ショ"))


def same_but_for_form(a: Column, b: Column) -> Column:
    """Whether names differ, but only in old and new character forms."""
    x, y = name_key(a), name_key(b)
    return (x != y) & (old_form_fold(x) == old_form_fold(y))


def without_marker(c: Column) -> Column:
    """The trimmed text, or nothing for a marker of an empty field."""
    t = F.trim(text(c))
    return F.when(t.isin(*EMPTY_MARKERS), "").otherwise(t)


def without_markers(cells: Column) -> Column:
    """without_marker of every cell of an array of normalised cells."""
    return F.when(F.arrays_overlap(cells, F.array(*[F.lit(m) for m in EMPTY_MARKERS])), F.transform(cells, without_marker)).otherwise(cells)


def looks_like_address(c: Column) -> Column:
    return (F.length(text(c)) >= 4) & text(c).rlike(ADDRESS)


def looks_like_name(c: Column) -> Column:
    return (text(c) != "") & ~looks_like_address(c) & (F.length(text(c)) <= 30)


def is_old_value(c: Column) -> Column:
    return text(c).rlike("[【】\\[\\]]")


def strip_old_marks(c: Column) -> Column:
    return F.trim(F.regexp_replace(text(c), "[【】\\[\\]]", ""))


def clean_mtext(c: Column) -> Column:
    """A drawing's formatted text without its format codes; paragraph marks become line breaks."""
    out = F.regexp_replace(text(c), "\\\\[WwHhAaCcFfPpQqTtLlOo][^;]*;", "")
    out = F.regexp_replace(F.regexp_replace(out, "[{}]", ""), "\\\\P", "\n")
    return F.regexp_replace(F.regexp_replace(out, "\\\\[^;]*;", ""), "^(?U)\\s+|(?U)\\s+$", "")


def first_line(c: Column) -> Column:
    return F.trim(F.element_at(F.split(c, "\n"), 1))


def classify(c: Column, plain: bool = False) -> Column:
    """Category of a drawing text by its first line."""
    t = first_line(F.trim(text(c)) if plain else clean_mtext(c))
    rules = (
        ("intersection_stake", t.rlike("^(-|交)(?U)\\d+\\.\\d+$")),
        ("existing_stake", t.rlike("^既(?U)\\d+\\.\\d+$")),
        ("restored_stake", t.rlike("^復(?U)\\d+\\.\\d+$")),
        ("calculated_stake", t.rlike("^計(?U)\\d+\\.\\d+$")),
        ("stake", t.rlike("^(?U)\\d+\\.\\d+$")),
        ("survey_code", t.startswith("P3P3-") | t.rlike("^R(?U)\\d+\\.\\d+\\.\\d+$")),
        ("parcel_number", t.rlike("^(?U)\\d+(-\\d+)?$")),
        ("public_land", t.rlike(PUBLIC_LAND)),
        ("land_use", t.isin(*LAND_USES)),
    )
    out = F.lit("other")
    for kind, test in reversed(rules):
        out = F.when(test, kind).otherwise(out)
    return out


def block_number(c: Column) -> Column:
    """Number of the block in a stake number, without its prefix; null if there is none."""
    return F.nullif(F.regexp_extract(text(c), "^[-交既復計]?((?U)\\d+)\\.", 1), F.lit(""))


def is_intersection(c: Column) -> Column:
    return text(c).startswith("-") | text(c).startswith("交")


def natural_key(c: Column) -> Column:
    """Parts of a parcel number as integers, for sorting; null for other texts."""
    t = nfkc(c)
    return F.when(t.rlike("^\\d+([-番の]+\\d+)*$"), F.transform(F.regexp_extract_all(t, F.lit("\\d+"), F.lit(0)), lambda x: x.cast("long")))


def join_nonempty(*columns: Column, sep: str = " / ") -> Column:
    return F.concat_ws(sep, *[F.nullif(text(c), F.lit("")) for c in columns])


def cross_checked_area(source: Column, read: Column) -> Column:
    """The read area, or the source's where the reading lost the decimal point or all after it."""
    s, r = area(source), area(read)
    whole, part = F.element_at(F.split(s, "\\."), 1), F.substring_index(s, ".", -1)
    lost = s.contains(".") & ~r.contains(".") & ((r == whole) | (r == F.concat(whole, part)))
    return F.when(lost, s).otherwise(r)


def number_or_text(c: Column) -> Column:
    """The value as a double where it reads as a number, else null; the text stays beside it."""
    return c.try_cast("double")
