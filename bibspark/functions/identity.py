"""Identity of books: identifiers, languages, genres, group keys and content hashes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import UNDEFINED_LANGUAGE
from .text import WHITE_CLASS, trimmed

# ---- languages -------------------------------------------------------------------------------------------------------

#: Two-letter codes, each with its three-letter code.
LANGUAGES = """
    aa aar ab abk af afr ak aka sq sqi am amh ar ara an arg hy hye as asm av ava ae ave ay aym az aze ba bak bm bam
    eu eus be bel bn ben bi bis bs bos br bre bg bul my mya ca cat ch cha ce che zh zho cu chu cv chv kw cor co cos
    cr cre cs ces da dan dv div nl nld dz dzo en eng eo epo et est ee ewe fo fao fj fij fi fin fr fra fy fry ff ful
    ka kat de deu gd gla ga gle gl glg gv glv el ell gn grn gu guj ht hat ha hau he heb hz her hi hin ho hmo hr hrv
    hu hun ig ibo is isl io ido ii iii iu iku ie ile ia ina id ind ik ipk it ita jv jav ja jpn kl kal kn kan ks kas
    kr kau kk kaz km khm ki kik rw kin ky kir kv kom kg kon ko kor kj kua ku kur lo lao la lat lv lav li lim ln lin
    lt lit lb ltz lu lub lg lug mk mkd mh mah ml mal mi mri mr mar ms msa mg mlg mt mlt mn mon na nau nv nav nr nbl
    nd nde ng ndo ne nep nn nno nb nob no nor ny nya oc oci oj oji or ori om orm os oss pa pan fa fas pi pli pl pol
    pt por ps pus qu que rm roh ro ron rn run ru rus sg sag sa san si sin sk slk sl slv se sme sm smo sn sna sd snd
    so som st sot es spa sc srd sr srp ss ssw su sun sw swa sv swe ty tah ta tam tt tat te tel tg tgk tl tgl th tha
    bo bod ti tir to ton tn tsn ts tso tk tuk tr tur tw twi ug uig uk ukr ur urd uz uzb ve ven vi vie vo vol cy cym
    wa wln wo wol xh xho yi yid yo yor za zha zu zul
"""
#: Three-letter codes for libraries' use, each with the code that the list above has.
BIBLIOGRAPHIC = {
    "alb": "sqi", "arm": "hye", "baq": "eus", "bur": "mya", "chi": "zho", "cze": "ces", "dut": "nld", "fre": "fra", "geo": "kat", "ger": "deu",
    "gre": "ell", "ice": "isl", "mac": "mkd", "mao": "mri", "may": "msa", "per": "fas", "rum": "ron", "slo": "slk", "tib": "bod", "wel": "cym",
}
#: Withdrawn two-letter codes, each with the code that the registry of subtags prefers.
DEPRECATED = {"in": "id", "iw": "he", "ji": "yi", "jw": "jv", "mo": "ro"}
#: Three-letter codes of languages without a two-letter code; a deployment may know more.
THREE_LETTERS = ["ang", "arc", "ast", "bho", "ceb", "chr", "cop", "crh", "csb", "dum", "egy", "enm", "fil", "fro", "frm", "fur", "gmh", "goh", "got", "grc", "gsw", "haw", "hsb", "jbo", "kab", "kok", "lad", "mai", "mga", "mul", "nap", "nds", "non", "pap", "pro", "sah", "scn", "sco", "sga", "sux", "syr", "szl", "tlh", "tpi", "tyv", "vec", "war", "zza"]


def language_codes(more: list[str] | None = None) -> dict[str, str]:
    """Every known code and the code that stands for it."""
    codes = LANGUAGES.split()
    two = dict(zip(codes[1::2], codes[::2], strict=True))
    known = {c: c for c in [*THREE_LETTERS, *(more or [])]} | two | {c: c for c in two.values()}
    return known | {b: known[t] for b, t in BIBLIOGRAPHIC.items()} | DEPRECATED


def literal_map(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def language(code: Column, more: list[str] | None = None) -> Column:
    """The base language of a tag ('en-Latn-US', 'eng' and 'EN' are 'en'); '' for what isn't a known language."""
    tag = F.lower(trimmed(F.coalesce(code, F.lit(""))))
    shaped = tag.rlike("^[a-z]{2,3}([-_][a-z0-9]{1,8})*$")
    return F.when(shaped, F.coalesce(F.try_element_at(literal_map(language_codes(more)), F.split_part(F.translate(tag, "_", "-"), F.lit("-"), F.lit(1))), F.lit(""))).otherwise("")


# ---- identifiers -----------------------------------------------------------------------------------------------------

ISBN, AMAZON, GOOGLE, GOODREADS = "isbn", "amazon", "google", "goodreads"
#: Types that may put two records into one book.
STRONG = [ISBN, AMAZON, GOOGLE, GOODREADS]
#: Types that identify nothing, and other names of types.
USELESS_TYPES = ["uuid", "urn", "uri", "calibre", "mobi-uid", "local"]
TYPE_NAMES = {"amazon-asin": AMAZON, "mobi-asin": AMAZON, "asin": AMAZON, "isbn-10": ISBN, "isbn-13": ISBN, "isbn10": ISBN, "isbn13": ISBN, "isbn_10": ISBN, "isbn_13": ISBN}
_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{32}"


def isbn_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[- ]", "")


def is_isbn(text: Column) -> Column:
    """A valid ISBN-13 with prefix 978 or 979, or a valid ISBN-10."""

    def valid(digits: Column) -> Column:
        def weighted(n: int, weight) -> Column:
            total = F.lit(0)
            for i in range(n):
                total = total + F.coalesce(F.substring(digits, i + 1, 1).try_cast("int"), F.lit(0)) * weight(i)
            return total

        last = F.when(F.upper(F.substring(digits, 10, 1)) == "X", 10).otherwise(F.coalesce(F.substring(digits, 10, 1).try_cast("int"), F.lit(0)))
        long_ = digits.rlike("^97[89][0-9]{10}$") & (weighted(13, lambda i: 3 if i % 2 else 1) % 10 == 0)
        short = digits.rlike("^[0-9]{9}[0-9Xx]$") & ((weighted(9, lambda i: 10 - i) + last) % 11 == 0)
        return long_ | short

    # A lambda over an array of one binds the stripped text, so that it is stripped once and not for every digit.
    return F.get(F.transform(F.array(isbn_digits(text)), valid), F.lit(0))


def is_placeholder(value: Column) -> Column:
    """Empty, or one character over and over."""
    return (value == "") | value.rlike("^([\\x00-\\x7F])\\1*$")


def is_strong(type_: Column, value: Column) -> Column:
    return type_.isin(STRONG) & ~is_placeholder(value) & ((type_ != ISBN) | is_isbn(value))


def clean_type(type_: Column) -> Column:
    low = F.lower(trimmed(type_))
    return F.coalesce(F.try_element_at(literal_map(TYPE_NAMES), low), low)


def is_uuid_like(value: Column) -> Column:
    """A UUID in any of its forms, except the one of zeros only, or a URN of one."""
    low = F.lower(value)
    bare = F.regexp_replace(low, "^uuid:", "")
    zero = F.regexp_replace(bare, "[-{}]", "").rlike("^0{32}$")
    return low.rlike("^urn:(uuid|calibre):") | (bare.rlike(f"^(\\{{({_UUID})\\}}|{_UUID})$") & ~zero)


def clean_value(type_: Column, value: Column) -> Column:
    """A value in the form of its cleaned type."""
    val = trimmed(value)
    isbn = F.upper(isbn_digits(F.regexp_replace(val, "^(?i)(urn:isbn:|isbn:)", "")))
    return F.when(type_ == ISBN, isbn).when(type_ == AMAZON, F.upper(val)).otherwise(val)


def clean_identifiers(identifiers: Column) -> Column:
    """array<struct<type,value>> cleaned, with one value for each type, in the order of types.

    ISBNs prefer 13 characters, then 10, then what came first; of other types the longest wins, the last of equals.
    """
    cleaned = F.transform(identifiers, lambda x: F.struct(clean_type(x["type"]).alias("type"), clean_value(clean_type(x["type"]), x["value"]).alias("value"), x["value"].alias("raw"), F.lower(trimmed(x["type"])).alias("given")))
    usable = F.filter(cleaned, lambda x: (x["given"] != "") & ~x["given"].isin(USELESS_TYPES) & (trimmed(x["raw"]) != "") & ~is_uuid_like(trimmed(x["raw"])) & (x["value"] != ""))

    def rank(x: Column, i: Column) -> Column:
        n = F.octet_length(x["value"])
        isbn = x["type"] == ISBN
        size = F.when(isbn, F.when(n == 13, 2).when(n == 10, 1).otherwise(0)).otherwise(n)
        return F.struct(x["type"].alias("type"), (-size).alias("s"), F.when(isbn, i).otherwise(-i).alias("i"), x["value"].alias("value"))

    ordered = F.array_sort(F.transform(usable, rank))
    first = F.filter(ordered, lambda x, i: (i == 0) | (F.get(ordered, i - 1)["type"] != x["type"]))
    return F.transform(first, lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value")))


# ---- genres ----------------------------------------------------------------------------------------------------------

#: Genre codes and the genre that each stands for.
GENRE_CODES = {
    "accounting": "Nonfiction",
    "adv_animal": "Action & Adventure",
    "adv_geo": "Travel",
    "adv_history": "History",
    "adv_maritime": "Action & Adventure",
    "adv_western": "Action & Adventure",
    "adventure": "Action & Adventure",
    "antique": "Classics",
    "antique_ant": "Classics",
    "antique_east": "Classics",
    "antique_european": "Classics",
    "antique_myths": "Classics",
    "antique_russian": "Classics",
    "aphorism_quote": "Nonfiction",
    "architecture_book": "Nonfiction",
    "auto_regulations": "Nonfiction",
    "banking": "Finance",
    "beginning_authors": "Nonfiction",
    "child_adv": "Juvenile Fiction",
    "child_det": "Juvenile Fiction",
    "child_education": "Juvenile Fiction",
    "child_prose": "Literary",
    "child_sf": "Science Fiction",
    "child_tale": "Juvenile Fiction",
    "child_verse": "Juvenile Fiction",
    "children": "Juvenile Fiction",
    "cinema_theatre": "Nonfiction",
    "city_fantasy": "Fantasy",
    "comp_db": "Computer Science",
    "comp_hard": "Computer Science",
    "comp_osnet": "Computer Science",
    "comp_programming": "Programming",
    "comp_soft": "Computer Science",
    "comp_www": "Computer Science",
    "computers": "Computer Science",
    "design": "Software Development & Engineering",
    "det_action": "Thrillers",
    "det_classic": "Classics",
    "det_crime": "Crime",
    "det_espionage": "Mystery & Detective",
    "det_hard": "Crime",
    "det_history": "Mystery & Detective",
    "det_irony": "Mystery & Detective",
    "det_police": "Crime",
    "det_political": "Mystery & Detective",
    "detective": "Mystery & Detective",
    "dragon_fantasy": "Fantasy",
    "dramaturgy": "Drama",
    "economics": "Business & Economics",
    "essays": "Nonfiction",
    "fantasy_fight": "Fantasy",
    "foreign_action": "Nonfiction",
    "foreign_adventure": "Action & Adventure",
    "foreign_antique": "Classics",
    "foreign_business": "Management",
    "foreign_children": "Juvenile Fiction",
    "foreign_comp": "Nonfiction",
    "foreign_contemporary": "Contemporary Fiction",
    "foreign_contemporary_lit": "Contemporary Fiction",
    "foreign_desc": "Nonfiction",
    "foreign_detective": "Mystery & Detective",
    "foreign_dramaturgy": "Drama",
    "foreign_edu": "Nonfiction",
    "foreign_fantasy": "Fantasy",
    "foreign_home": "Nonfiction",
    "foreign_humor": "Humor",
    "foreign_language": "Nonfiction",
    "foreign_love": "Romance",
    "foreign_novel": "Nonfiction",
    "foreign_other": "Nonfiction",
    "foreign_poetry": "Poetry",
    "foreign_prose": "Literary",
    "foreign_psychology": "Nonfiction",
    "foreign_publicism": "Nonfiction",
    "foreign_religion": "Religion",
    "foreign_sf": "Science Fiction",
    "geo_guides": "Travel",
    "geography_book": "Travel",
    "global_economy": "Nonfiction",
    "historical_fantasy": "Fantasy",
    "home": "Nonfiction",
    "home_cooking": "Nonfiction",
    "home_crafts": "Nonfiction",
    "home_diy": "Nonfiction",
    "home_entertain": "Nonfiction",
    "home_garden": "Nonfiction",
    "home_health": "Nonfiction",
    "home_pets": "Nonfiction",
    "home_sex": "Nonfiction",
    "home_sport": "Nonfiction",
    "humor": "Humor",
    "humor_anecdote": "Humor",
    "humor_fantasy": "Fantasy",
    "humor_prose": "Literary",
    "humor_verse": "Humor",
    "industries": "Nonfiction",
    "job_hunting": "Nonfiction",
    "literature_18": "Nonfiction",
    "literature_19": "Nonfiction",
    "literature_20": "Nonfiction",
    "love_contemporary": "Romance",
    "love_detective": "Romance",
    "love_erotica": "Romance",
    "love_fantasy": "Romance",
    "love_history": "Romance",
    "love_sf": "Romance",
    "love_short": "Romance",
    "magician_book": "Fantasy",
    "management": "Management",
    "marketing": "Management",
    "military_special": "War & Military",
    "music_dancing": "Music",
    "narrative": "Nonfiction",
    "newspapers": "Nonfiction",
    "nonf_biography": "Biography & Autobiography",
    "nonf_criticism": "History & Criticism",
    "nonf_publicism": "Nonfiction",
    "nonfiction": "Nonfiction",
    "org_behavior": "Management",
    "paper_work": "Nonfiction",
    "pedagogy_book": "Psychology",
    "periodic": "Nonfiction",
    "personal_finance": "Finance",
    "poetry": "Poetry",
    "popadanec": "Fantasy",
    "popular_business": "Management",
    "prose_classic": "Classics",
    "prose_counter": "Literary",
    "prose_history": "Literary",
    "prose_military": "War & Military",
    "prose_rus_classic": "Classics",
    "prose_su_classics": "Classics",
    "psy_alassic": "Psychology",
    "psy_childs": "Psychology",
    "psy_generic": "Psychology",
    "psy_personal": "Psychology",
    "psy_sex_and_family": "Psychology",
    "psy_social": "Psychology",
    "psy_theraphy": "Psychology",
    "real_estate": "Nonfiction",
    "ref_dict": "Science",
    "ref_encyc": "Science",
    "ref_guide": "Science",
    "ref_ref": "Science",
    "reference": "Science",
    "religion": "Religion",
    "religion_esoterics": "Religion",
    "religion_rel": "Religion",
    "religion_self": "Religion",
    "russian_contemporary": "Contemporary Fiction",
    "russian_fantasy": "Fantasy",
    "sci_biology": "Science",
    "sci_chem": "Science",
    "sci_culture": "Nonfiction",
    "sci_history": "History",
    "sci_juris": "Nonfiction",
    "sci_linguistic": "Nonfiction",
    "sci_math": "Science",
    "sci_medicine": "Science",
    "sci_philosophy": "Philosophy",
    "sci_phys": "Science",
    "sci_politics": "Political Science",
    "sci_religion": "Religion",
    "sci_tech": "Nonfiction",
    "science": "Science",
    "sf": "Science Fiction",
    "sf_action": "Science Fiction",
    "sf_cyberpunk": "Cyberpunk",
    "sf_detective": "Science Fiction",
    "sf_fantasy": "Fantasy",
    "sf_heroic": "Science Fiction",
    "sf_history": "Alternative History",
    "sf_horror": "Science Fiction",
    "sf_humor": "Science Fiction",
    "sf_social": "Science Fiction",
    "sf_space": "Science Fiction",
    "short_story": "Nonfiction",
    "sketch": "Nonfiction",
    "small_business": "Management",
    "sociology_book": "Political Science",
    "stock": "Finance",
    "thriller": "Thrillers",
    "unrecognised": "Nonfiction",
    "upbringing_book": "Psychology",
    "vampire_book": "Fantasy",
    "visual_arts": "Nonfiction",
}
#: The genres there are.
GENRES = [
    "Action & Adventure",
    "Alternative History",
    "Artificial Intelligence",
    "Biography & Autobiography",
    "Business & Economics",
    "Classics",
    "Computer Science",
    "Contemporary Fiction",
    "Crime",
    "Cyberpunk",
    "Drama",
    "Fantasy",
    "Finance",
    "History",
    "History & Criticism",
    "Humor",
    "Juvenile Fiction",
    "Leadership",
    "Literary",
    "Management",
    "Music",
    "Mystery & Detective",
    "Nonfiction",
    "Philosophy",
    "Poetry",
    "Political Science",
    "Programming",
    "Project Management",
    "Psychology",
    "Religion",
    "Romance",
    "Science",
    "Science Fiction",
    "Software Development & Engineering",
    "Thrillers",
    "Travel",
    "War & Military",
    "Young Adult Fiction",
]


def one_genre(tag: Column) -> Column:
    """The genre of a code or of a genre's name in any case; null for others."""
    known = {g.lower(): g for g in GENRES} | GENRE_CODES
    return F.try_element_at(literal_map(known), F.lower(trimmed(tag)))


def genres(tags: Column) -> Column:
    """Genres of raw tags in order, each once; a tag that isn't one as a whole is split at '/'."""
    each = F.transform(tags, lambda t: F.when(one_genre(t).isNotNull(), F.array(one_genre(t))).otherwise(F.transform(F.split(t, "/"), one_genre)))
    return F.array_distinct(F.filter(F.flatten(each), lambda g: g.isNotNull()))


# ---- keys ------------------------------------------------------------------------------------------------------------

_SEPARATOR = "\x1f"


def author_key(name: Column) -> Column:
    """A name's words in lower case and sorted, so that their order and commas don't matter."""
    words = F.filter(F.split(F.lower(name), f"(,|{WHITE_CLASS})+"), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def group_key(title: Column, authors: Column, lang: Column) -> Column:
    """What makes files of one library one book: title, authors in any order, language."""
    names = F.array_sort(F.filter(F.transform(F.coalesce(authors, F.array().cast("array<string>")), author_key), lambda k: k != ""))
    tongue = F.lower(trimmed(F.coalesce(lang, F.lit(""))))
    return F.concat_ws(_SEPARATOR, F.lower(trimmed(title)), F.array_join(names, ","), F.when(tongue == "", UNDEFINED_LANGUAGE).otherwise(tongue))


def short_number(value: Column) -> Column:
    """A double in its shortest form, whole numbers without a point; '' for null."""
    text = F.when((F.abs(value) < 1e15) & (value == F.floor(value)), F.format_string("%d", F.floor(value).cast("long"))).otherwise(value.cast("string"))
    return F.coalesce(text, F.lit(""))


def distinct_folds(names: Column, fold: Column | None = None) -> Column:
    """Trimmed names that aren't blank, the first spelling of each; ``fold`` holds their folds in the same order, else lower case is compared."""
    clean = F.transform(names, trimmed)
    keys = F.transform(clean, F.upper) if fold is None else fold
    rows = F.transform(F.arrays_zip(keys.alias("k"), clean.alias("n")), lambda x, i: F.struct(x["k"].alias("k"), i.alias("i"), x["n"].alias("n")))
    # Sorted by key and place, the first of each run of keys is its first spelling.
    runs = F.array(F.array_sort(F.filter(rows, lambda x: x["n"] != "")))
    first = F.transform(runs, lambda s: F.filter(s, lambda x, i: (i == 0) | ~F.get(s, i - 1)["k"].eqNullSafe(x["k"])))
    return F.transform(F.array_sort(F.transform(F.get(first, F.lit(0)), lambda x: F.struct(x["i"].alias("i"), x["n"].alias("n")))), lambda x: x["n"])


def content_hash(title: Column, authors: Column, series: Column, series_number: Column, lang: Column, annotation: Column, publisher: Column, year: Column, rating: Column, genre_names: Column, identifiers: Column) -> Column:
    """A fingerprint of what a record says; files aren't part of it.  Lists come cleaned and are sorted here."""
    empty = F.array().cast("array<string>")
    text = lambda c: F.coalesce(c, F.lit(""))
    bar = lambda c: F.array_join(F.array_sort(F.coalesce(c, empty)), "|")
    pairs = F.transform(identifiers, lambda x: F.concat(x["type"], F.lit("="), x["value"]))
    parts = [text(title), bar(authors), text(series), short_number(series_number), text(lang), text(annotation), text(publisher), F.coalesce(year, F.lit(0)).cast("string"), text(rating.cast("string")), bar(genre_names), bar(pairs)]
    return F.sha2(F.concat_ws(_SEPARATOR, *parts), 256)
