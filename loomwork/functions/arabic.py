"""What Arabic postings and CVs name: level, workplace, employment, sections and years, by folded phrases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.script import fold_arabic

# Folded phrases by label.
SECTIONS = {
    "experience": ["الخبره", "الخبرات", "الخبره العمليه", "السيره المهنيه", "التاريخ الوظيفي"],
    "education": ["التعليم", "المؤهلات", "المؤهل العلمي", "الدراسه", "التعليم الاكاديمي"],
    "skills": ["المهارات", "المهارات التقنيه", "المهارات الشخصيه", "القدرات", "الكفاءات"],
    "languages": ["اللغات", "اللغه"],
    "certifications": ["الشهادات", "الدورات", "الدورات التدريبيه", "التدريب"],
    "projects": ["المشاريع", "المشروعات", "الاعمال"],
    "summary": ["نبذه", "الملخص", "نبذه شخصيه", "الهدف الوظيفي", "عن نفسي"],
}
LEVELS = {
    "intern": ["متدرب", "متدربه", "تدريب"],
    "junior": ["مبتدئ", "مبتدىء", "حديث التخرج", "خريج جديد", "مساعد"],
    "mid": ["متوسط", "خبره متوسطه"],
    "senior": ["اول", "كبير", "خبير", "سينيور"],
    "staff": ["قائد فريق", "رئيس فريق", "مشرف", "معماري"],
    "principal": ["مدير تنفيذي", "مدير عام", "رئيس قطاع", "مدير اداره"],
}
WORKPLACES = {"remote": ["عن بعد", "من المنزل", "ريموت", "عمل عن بعد"], "hybrid": ["هجين", "مختلط", "نظام هجين"], "onsite": ["من المكتب", "حضوري", "في الموقع", "بالمقر"]}
EMPLOYMENTS = {
    "internship": ["تدريب صيفي", "برنامج تدريبي", "تدريب"],
    "part_time": ["دوام جزئي", "بدوام جزئي", "جزئي"],
    "temporary": ["مؤقت", "موسمي"],
    "contract": ["عقد", "بعقد", "تعاقد", "حر"],
    "full_time": ["دوام كامل", "بدوام كامل", "وظيفه كامله", "تعيين دائم"],
}
NUMBERS = {"ثلاث": 3, "اربع": 4, "خمس": 5, "ست": 6, "سبع": 7, "ثمان": 8, "ثماني": 8, "تسع": 9, "عشر": 10, "عشره": 10, "خمسه عشر": 15, "عشرين": 20}
YEAR = "(?:سنه|سنوات|سنين|عام|اعوام)"
TWO_YEARS = r"(?:^|[^\p{L}])(?:سنتين|سنتان|عامين|عامان)(?:[^\p{L}]|$)"


def pairs(items: list[tuple[str, str]]) -> Column:
    """(key, value) pairs as one array."""
    return F.array(*[F.struct(F.lit(a).alias("key"), F.lit(b).alias("value")) for a, b in items])


def first_pair(items: list[tuple[str, str]], fits: Callable[[Column], Column]) -> Column:
    """The value of the first pair whose key fits; null if none does."""
    return F.get(F.filter(pairs(items), lambda p: fits(p["key"])), F.lit(0))["value"]


def _once(col: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, also where f uses it for every element of an array."""
    return F.get(F.transform(F.array(col), f), 0)


def label_by_phrase(col: Column, vocabulary: dict[str, list[str]], folded: bool = False) -> Column:
    """The label of the longest phrase that the folded text contains; null if none."""
    phrases = sorted(((p, label) for label, ps in vocabulary.items() for p in ps), key=lambda x: -len(x[0]))
    return _once(col if folded else fold_arabic(col), lambda text: first_pair(phrases, lambda p: F.contains(text, p)))


def sections_named(col: Column, folded: bool = False) -> Column:
    """Sorted names of the sections whose Arabic headings the text contains."""
    headings = pairs([(p, name) for name, ps in sorted(SECTIONS.items()) for p in ps])
    hits = _once(col if folded else fold_arabic(col), lambda text: F.filter(headings, lambda p: F.contains(text, p["key"])))
    return F.array_distinct(F.transform(hits, lambda p: p["value"]))


def arabic_years(col: Column, folded: bool = False) -> Column:
    """The largest plausible number of years (over 0, at most 60) named in Arabic by digits, words or the dual; null if none."""
    text = col if folded else fold_arabic(col)
    digits = F.transform(F.regexp_extract_all(text, F.lit(rf"(\d+(?:\.\d+)?)\s*\+?\s*{YEAR}"), 1), lambda x: x.try_cast("double"))
    words = F.transform(F.regexp_extract_all(text, F.lit(rf"({'|'.join(sorted(NUMBERS, key=len, reverse=True))})\s+{YEAR}"), 1),
        lambda x: F.try_element_at(F.create_map(*[F.lit(y) for k, v in NUMBERS.items() for y in (k, float(v))]), x))
    dual = F.when(text.rlike(TWO_YEARS), F.array(F.lit(2.0))).otherwise(F.array().cast("array<double>"))
    return F.array_max(F.filter(F.concat(digits, words, dual), lambda x: (x > 0) & (x <= 60)))
