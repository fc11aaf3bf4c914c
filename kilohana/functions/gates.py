"""Gates that decide which sentences enter a corpus: rule tables over one text column, all in built-in expressions.

The lists are fixed values in their natural order. Each rule is written once and gives a Column and the SQL that says the same.
Word boundaries are those of letters, digits and the underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilohana.functions import text as T

#: A sentence that holds one of these is skipped.
SKIP = [
    "About Us",
    "Our Partners",
    "Terms of Use",
    "Privacy",
    "Contact Us",
    "Skip to main content",
    "Explore Ulukau",
    "Menu",
    "Help",
    "English currently selected",
    "Hawai‘i",
    "Hawai\\u2018i",
    "Article titles: ",
    "Article translations: some articles have been translated, this is the text of those translations.",
    "Dedication text: This text was added by people who transcribed Page text as a dedication for their transcription work.",
    "This text is divided into pages and is available for",
    "Is printed and Published",
    "THE NATIONAL HERALD",
    "This text is available",
    "All Orders Promptly Attended to",
    "Select an option below",
    "Already a Honolulu",
    "Log in now",
    "Get unlimited access",
    "Subscribe Now",
    "All rights reserved",
    "The developer is preparing the property",
    "demolition process",
    "Stay in touch with ",
    "It's FREE!",
    "Don't miss out on what's happening!",
    "This form is protected by reCAPTCHA.",
    "next book",
    "cursor:",
    "font-size:",
    "Look up any word",
    "Copyright",
    "Acknowledgments",
    "More Information",
    "text-align:",
    "margin-bottom:",
    "Vote Hawaii's Best",
    "Javascript",
    "Internet",
    "Scripting",
    "Warning",
]

#: Expressions of publishers' and catalogues' lines, in order.
PATTERNS = [
    r"No part of this book may be reproduced",
    r"The Center provides professional and material resources necessary to address this goal",
    r"Kuleana Kope|nona nā kuleana a pau|ʻAʻole e hana kope",
    r"Hale Kuamoʻo.*University of Hawaiʻi",
    r"Ka Haka ʻUla O Keʻelikōlani",
    r"Paʻi ʻia e ka.*Kulanui o Hawaiʻi",
    r"Hoʻopuka ʻia e ka.*Hale Kuamoʻo",
    r"Hoʻopuka ʻia e",
    r"Ko.*olauloa Early Education Program",
    r"KA HUI SIWILA HAWAIʻI O KOʻOLAULOA",
    r"\(\d{3}\)\s*\d{3}-\d{4}",
    r"\d+ West .* Street.*Hilo.*Hawaii.*\d{5}",
    r"@.*\.edu|www\.",
    r"Kākau a paʻi kiʻi ʻia na",
    r"Hoʻokele ʻia na.*lāua",
    r"Loihape ʻia na",
    r"Hakulau ʻia na.*lāua",
    r"ke kālā haʻawina na ka.*Pekelala",
    r"ʻOihana Hoʻonaʻauao Pekelala",
    r"University of Hawaiʻi Foundation",
    r"Inā makemake ʻoe e kākoʻo",
    r"Na ka Hale Kuamoʻo e hoʻomohala",
    r"Ua hoʻokumu ʻia ka Hale Kuamoʻo",
    r"ʻO ka Hale Kuamoʻo ke keʻena",
    r"^For .* and .* in our lives",
    r"\.indd \d+ \d+/\d+/\d+ \d+:\d+:\d+ [AP]M",
    r"\w+ Book v\d+\.\d+\.indd",
    r"Kamehameha Schools.*established.*\d{4}",
    r"Students benefit from.*classrooms",
    r"What happens after.*\?",
    r"Why does.*\?",
    r"How can.*\?",
    r"FIVE TIPS|FIve tIPs",
    r"kaMehaMeha PUblIshIng",
    r"Amplifying Hawaiian Perspectives",
    r"^Printed in [A-Z][a-z]+$",
    r"^ISBN:\s*\d+",
    r"ISBN \d+-\d+-\d+-\d+",
    r"He Aha Ka Mea .*Ai No Ka .*Aina Awakea\?",
    r"Kuleana Kope.*\d{4}",
    r"^[A-Z\s]{20,}$",
    r"^.*A division of Kamehameha Schools.*$",
    r"^.*Hale Kuamo.o.*$",
    r"^[A-Z\s']{30,}$",
    r"Printed in [A-Z][a-z]+\s*\$\d+\.\d+",
    r"^Ho omohala ia na ka Hale Kuamo o",
    r"^MALIA KRUGER.*$",
    r"Inquiries should be addressed to:",
    r"Its mission: ka mālama",
    r"Founded in \d{4}.*laboratory public charter school",
    r"The school partners with community groups",
    r"The school carries the name of.*\(\d{4}–\d{2,4}\)",
    r".*life symbolizes integral qualities.*contemporary Native Hawaiians",
    r"aboUt thIs book.*cReatIon",
    r"The story was developed to create meaningful connections",
    r"students learned about composition.*texture",
    r"Haumāna were guided through.*scaffolding",
    r"students endured draft after draft",
    r"Born was a story based on moʻokaʻao",
    r"According to Kumu.*creative drawing and writing processes",
    r"children discovered that the retelling",
    r"Today, Kamehameha Schools is a comprehensive",
    r"Kamehameha Schools also provides.*additional students",
    r"no ke kUla$",
    r"^SONG TO HAWAIIAN\.$",
    r"HAWAIIAN MISSION CHILDREN'S SOCIETY",
    r"^The wind from over the sou$",
    r"^Sing's sweetly aloha to me$",
    r"^The waves as they fall on the sand$",
    r"^[A-Z][A-Z ]+\.$",
    r"Historical Society \d+ [A-Z][a-z]+ Street",
    r"Hawaiian Historical Society",
    r"Hawaiʻi and the Pacific Islands\.",
    r"CommitteeHawaiian Historical",
    r"For this assistance we thank [A-Z][a-z]+",
    r"We are grateful to Dr\.",
    r"Hawaiian language newspapers carried out by",
    r"withfunding from the University",
    r"Hawai-ian Historical Society\.",
    r"Honolulu, Hawaiʻi \d{5}",
    r"Photographer unknown\.",
    r"Courtesy [A-Z][a-z]+ [A-Z]\. [A-Z][a-z]+\.",
    r"Hawaiian Language Reprint",
    r"Foundation$",
    r"Committee$",
    r"Publications$",
    r"ACKNOWLEDGMENTS",
    r"FOREWORD",
    r"INTRODUCTION",
    r"FOR FURTHER STUDY",
    r"Ph\.D\. dissertation",
    r"University Press",
    r"Originally published:",
    r"Manuscript in Library of Congress",
    r"Hawaiian Journal of History",
    r"Associated University Presses",
    r"^\d{2}—\d{2}\.$",
    r"^\[\d{4}—\d{2}\]$",
    r"^Page$",
    r"^Date$",
    r"palapala mele/sheet music",
    r"^Ka [A-Z][a-z]+ \d{2}-\d{2}-\d{4}$",
    r"^ʻaoʻao inoa mele paʻi ʻia ma lā$",
    r"^[A-Z][a-z]+ \d{2}-\d{2}-\d{4} \d+ [A-Z][a-z]+$",
    r"San Francisco: [A-Z][a-z]+ and [A-Z][a-z]+ Model$",
    r"Honolulu: [A-Z][a-z]+ [A-Z][a-z]+, \d{4}",
    r"Washington, D\.C\., \d{4}\.$",
    r"Rutland, VT: [A-Z][a-z]+ [A-Z]\. [A-Z][a-z]+",
    r"Video, \d+ min\., \d{4}\.$",
    r"^\d+ \([A-Z][a-z]+\), \d+—\d+\.$",
    r"\[\s*[a-z]+\s*\]$",
    r"Lāʻie: Institute for Polynesian Studies",
    r"^Committee is assisting$",
    r"These purposes are not limited to particular",
    r"^Membership is open to all$",
    r"Associate$",
    r"Curator, Hawaiian Collection",
    r"Hamilton Library, University",
    r"teacher at t$",
    r"and [A-Z][a-z]+ [A-Z][a-z]+, with$",
    r"Bishop.*Museum",
    r"^\s*Bishop\s*\[\s*[xiv]+\s*\]\s*Museum\s*$",
    r"^Published in Date\s*\d*\s*[A-Z][a-z]*$",
    r"^Ka Makaainana \d{2}-\d{2}-\d{4}\s*\d*\s*[A-Z][a-z]*$",
    r"^Spencer \d{4}\s*\d*\s*[A-Z][a-z]*$",
    r"^Nakanaela-[IVX]+ \d{4}\s*\d*\s*[A-Z][a-z\s]*$",
    r"^Ka Lei Momi \d{2}-\d{2}-\d{4}\s*[A-Z][a-z]*$",
    r"^Momi \d{2}-\d{2}-\d{4}.*ʻaoʻao inoa mele",
    r"Typescript edited by.*Hart.*King.*Hawaiʻi State",
    r"Archives.*Honolulu.*———\.",
    r"^[A-Z][a-z]+ O [A-Z][a-z]+$",
    r"^[A-Z][a-z]+ O Ka [A-Z][a-z]+ [A-Z][a-z]+$",
]

KEYWORDS = [
    "Hale Kuamoʻo", "University of Hawaiʻi", "Kulanui o Hawaiʻi", "Ka Haka ʻUla O Keʻelikōlani", "Kuleana Kope", "copyright", "Kelepona:", "Kelepaʻi:",
    "hale kuamoo@", "www.olelo.hawaii.edu", "Kamehameha Schools", "Princess Bernice Pauahi", "charter school", "kindergarten", "first-grade",
    "classroom", "students", "teachers", "Koʻolauloa Early Education Program", "KA HUI SIWILA HAWAIʻI", "Hoʻopuka ʻia e", "ISBN", "Kaipāpaʻu",
    "Aina Awakea", "mission", "founded", "laboratory", "curriculum", "community groups", "Paepae o Heʻeia", "Aloha ʻĀina Health Center", "Ulupō Heiau",
    "Samuel Mānaiakalani Kamakau", "genealogist", "historian", "legislator", "composition", "color blending", "scaffolding", "vocabulary", "fluency",
    "moʻokaʻao", "oral tradition", "comprehensive educational system", "preschool sites", "financial aid", "scholarships", "Historical Society",
    "Foundation", "Committee", "Publications", "acknowledgments", "foreword", "introduction", "bibliography", "dissertation", "University Press",
    "originally published", "manuscript", "library", "congress", "archives", "journal", "associated", "presses", "photographer", "courtesy", "reprint",
    "series", "street", "address", "zip", "cover", "photograph", "assistance", "grateful", "thank", "funding", "curator", "collection", "hamilton",
    "mānoa", "associate", "professor", "research", "carried out", "newspapers", "basham", "bobbit", "makekau", "stillman", "pacific islands",
    "Bishop Museum", "Museum", "Archives", "Honolulu", "typescript", "edited by", "Ka Makaainana", "Spencer", "Nakanaela", "Ka Lei Momi", "Momi",
    "published in", "date", "ʻaoʻao inoa mele", "paʻi ʻia ma lā",
]

ENGLISH = [
    "copyright", "university", "foundation", "published", "printed", "street", "phone", "email", "website", "www", "http", "com", "edu", "author",
    "editor", "illustrator", "funded", "supported", "grant", "the", "and", "that", "with", "for", "was", "were", "are", "they", "have", "from", "this",
    "what", "when", "where", "how", "why", "students", "classroom", "school", "teacher", "grade", "learning", "book", "story", "chapter", "page",
    "text", "lesson", "activity", "project", "research", "community", "family", "children", "youth",
]

#: A sentence that is one of these is skipped.
SKIP_EXACT = ["OLELO HOOLAHA."]
#: Titles in capitals: passes where two words are in the dictionary.
CAPITALS = r"^[A-Z][A-Z ]+\.$"
#: (reason, expression) of rules behind the list above, in order.
LATER = [
    ("street address", r"\d+\s+[A-Z][a-z]+.*Street"),
    ("Hawaiian Historical Society", r"Hawaiian Historical Society"),
    ("Pacific Islands description", r"Hawaiʻi and the Pacific Islands"),
    ("Committee pattern", r"Committee.*Hawaiian.*Historical"),
    ("acknowledgment", r"For this assistance.*thank|We are grateful.*Dr\."),
    ("funding/research", r"Hawaiian language newspapers.*carried out|funding.*University"),
    ("institutional metadata", r"^\s*[A-Z][a-z]*\s*(Historical\s*)?Society.*[A-Z][a-z]+.*Street\s*$"),
    ("incomplete academic title", r"teacher at t$|Associate$|Curator.*Collection$"),
    ("dedication", r"^For .+? and .+? in our lives"),
]
DIALECT = ["ta", "te", "tana", "tona", "ta mata", "ta alii", "ta aina"]
HAWAIIAN = ["aloha", "mahalo", "ohana", "keiki", "kane", "wahine", "alii", "aina", "pono", "mana", "hula", "makai", "mauka", "pau", "wiki"]
PARTICLES = "o|i|a|e|ka|ke|na|he|mai|aku|ana|ia"
_A, _Z = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
LABEL = r"^(?:No|P)\.?[\p{Nd}\p{P}$+<=>^`|~]*$"
PLACES = "ka|ke|o|a|i|ma|no|me|lā|ola|ali|aina|mau|pau|kauikeaouli|kamehameha|hawaii|honolulu|kona|maui|molokai|lanai|kohala"
SHORT_WORDS = "ka|ke|o|a|i|ma|no|me|lā|na|ia|eia|oia"
CREDIT = r"^(?:written by|illustrated by|edited by|translated by|and|by)$"
NOT_ENGLISH = [
    rf"(?i){_A}(?:{PARTICLES})\s+(?:{PARTICLES}){_Z}",
    rf"(?i){_A}(?:oia|eia|pela|penei|pela\s+no|oia\s+no){_Z}",
    rf"(?i){_A}ua\s+[\p{{L}}\p{{N}}_]+ia{_Z}",
    rf"(?i){_A}e\s+[\p{{L}}\p{{N}}_]+(?:ana|ia|ina){_Z}",
]
PLAIN_TEXT = r"""^[A-Za-z\s.,!?:;\-'"0-9()]+$"""


def _any(c: Column, tests: list[Column]) -> Column:
    e = F.lit(False)
    for x in tests:
        e = e | x
    return e


def skipped(c: Column) -> Column:
    return _any(c, [c.contains(s) for s in SKIP]) | c.isin(SKIP_EXACT) | F.trim(c).rlike(LABEL)


def accepted(c: Column, min_words: int = 1) -> Column:
    """A text with the mark ‘ passes; else enough words, no numbered label, nothing of the skip lists."""
    return c.contains("‘") | ((T.str_word_count(c) >= min_words) & ~skipped(c))


def accepted_hawaiian(c: Column, min_words: int = 1) -> Column:
    """Enough words and nothing skipped, and an okina or apostrophe, a particle or place, or a macron."""
    sign = c.rlike("['ʻ]") | c.rlike(rf"(?iu){_A}(?:{PLACES}){_Z}") | c.rlike("[āēīōūĀĒĪŌŪ]")
    return (T.str_word_count(c) >= min_words) & ~skipped(c) & sign


def words(c: Column) -> Column:
    """Small words without marks; an empty string where nothing is left."""
    return F.transform(F.split(T.ascii_lower(c), r"\s+"), lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}_]", ""))


def dictionary_key(w: Column) -> Column:
    return F.translate(w, "āēīōūʻ`", "aeiou")


def _english(c: Column, known: Column, substantial: Column) -> Column:
    low = T.ascii_lower(c)
    w = F.filter(words(c), lambda x: F.octet_length(x) > 2)
    share = F.size(F.filter(w, lambda x: x.isin(ENGLISH))) / F.greatest(F.size(w), F.lit(1))
    plain = c.rlike(PLAIN_TEXT) & ~_any(c, [low.contains(x) for x in HAWAIIAN]) & (F.size(w) > 3)
    no = c.rlike("[ʻāēīōū]") | ((substantial > 0) & (known / F.greatest(substantial, F.lit(1)) >= 0.3)) | _any(c, [c.rlike(x) for x in NOT_ENGLISH]) | _any(c, [low.contains(x) for x in DIALECT])
    return ~no & ((share > 0.5) | plain)


def _reason(c: Column, known: Column, substantial: Column) -> Column:
    """The first rule that rejects the trimmed text, or null."""
    size = F.octet_length(c)
    n = F.size(words(c))
    low = T.ascii_lower(c)
    keys = F.lit(0)
    for k in KEYWORDS:
        keys = keys + low.contains(_lower(k)).cast("int")
    short = F.when((known >= 2) | (known / F.greatest(n, F.lit(1)) >= 0.5), None)
    short = short.when(c.rlike(rf"[ʻāēīōū]|{_A}(?:{SHORT_WORDS}){_Z}"), F.when(c.rlike("(?i)" + CREDIT), "English fragment")).otherwise("short non-Hawaiian (<20 chars)")
    which = F.lit(None).cast("int")
    for i in range(len(PATTERNS) - 1, -1, -1):
        hit = c.rlike("(?d)" + PATTERNS[i])
        which = F.when(hit & (known < 2) if PATTERNS[i] == CAPITALS else hit, i + 1).otherwise(which)
    which = F.when(c.rlike("(?d)" + "|".join(f"(?:{p})" for p in PATTERNS)), which)
    e = F.when(_english(c, known, substantial), "primarily English")
    e = F.when((n > 5) & (keys / n > 0.20), "publisher keywords").otherwise(e)
    for name, rx in reversed(LATER):
        e = F.when(c.rlike("(?d)" + rx), name).otherwise(e)
    e = F.coalesce(F.concat(F.lit("pattern "), which.cast("string")), e)
    return F.when(size < 8, "too_short (<8 chars)").when(size < 20, short).otherwise(e)


def _lower(s: str) -> str:
    """ASCII letters small, as byte-wise functions do."""
    return "".join(c.lower() if c.isascii() else c for c in s)


def judged(rows: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """(key, reason, english) of every row with a text: the first rejecting rule, and whether the text is primarily English.

    dictionary: (word), normalised. Words are counted by their places in the dictionary through one join on the word; a word of a row joins once.
    """
    t = rows.where(F.col(text).isNotNull()).select(key, F.regexp_replace(text, r"^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$", "").alias("_t"))
    w = t.select(key, F.explode(words(F.col("_t"))).alias("_w")).where(F.octet_length("_w") > 1)
    w = w.groupBy(key, dictionary_key(F.col("_w")).alias("word")).agg(F.count("*").alias("_n"))
    k = w.join(dictionary.select("word", F.lit(1).alias("_d")), "word", "left").groupBy(key).agg(F.sum(F.when(F.col("_d").isNotNull(), F.col("_n")).otherwise(0)).alias("_known"), F.sum("_n").alias("_all"))
    j = t.join(k, key, "left").na.fill(0, ["_known", "_all"])
    c = F.col("_t")
    return j.select(key, _reason(c, F.col("_known"), F.col("_all")).alias("reason"), _english(c, F.col("_known"), F.col("_all")).alias("english"))
