"""Localized labels, role inference, relation ranks and status words, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumengraph.functions import text as T

# Labels by locale (Turkish, Arabic, English).
RELATION_LABELS = {
    "Calls": ("çağırır", "يستدعي", "calls"),
    "Imports": ("içe aktarır", "يستورد", "imports"),
    "Extends": ("genişletir", "يمتد من", "extends"),
    "Implements": ("uygular", "ينفّذ", "implements"),
    "References": ("başvurur", "يشير إلى", "references"),
    "Contains": ("içerir", "يحتوي", "contains"),
    "DependsOn": ("kullanır", "يستخدم", "uses"),
    "Reads": ("okur", "يقرأ", "reads"),
    "Writes": ("yazar", "يكتب", "writes"),
    "Transforms": ("dönüştürür", "يحوّل", "transforms"),
    "Produces": ("üretir", "ينتج", "produces"),
}
COUNTS = ("%d dosya · %d sembol", "%d ملف · %d رمز", "%d files · %d symbols")
SHOWN = ("%d/%d modül", "%d/%d وحدة", "%d/%d modules")
SUBTITLE = ("Koddan otomatik üretildi · %d/%d modül · %d bağ", "مُولَّد تلقائيًا من الشيفرة · %d/%d وحدة · %d ارتباط", "Generated from code · %d/%d modules · %d links")
PACKAGES = ("Cargo bağımlılıklarından üretildi · %d/%d sandık · %d bağ", "مُولَّد من تبعيات Cargo · %d/%d صندوق · %d ارتباط", "Built from Cargo dependencies · %d/%d crates · %d links")
BOTH, BINARY, LIBRARY = ("kütüphane+ikili", "مكتبة+تنفيذي", "lib+bin"), ("ikili", "تنفيذي", "binary"), ("kütüphane", "مكتبة", "library")
LINES, FAR = ("%s · %d satır", "%s · %d سطر", "%s · %d lines"), ("dış depo", "مستودع خارجي", "external repo")
WORKSPACE_OF, FAR_OF = ("çalışma alanı · %d sandık", "مساحة عمل · %d صندوق", "workspace · %d crates"), ("dış depo · %d sandık", "مستودع خارجي · %d صندوق", "external repo · %d crates")
FILE_LINKS = ("Dosya bağımlılıkları (veri dosyası bulunamadı)", "تبعيات الملفات", "File dependencies (no data files found)")
DEPENDS, USES = ("bağımlı", "يعتمد", "depends"), ("kullanır ×%d", "يستخدم ×%d", "uses ×%d")
# Line styles by what a record calls them, and their strokes (width, dashes).
EDGE_KINDS = {"strong": "emphasis", "emphasis": "emphasis", "security": "security", "dashed": "dashed", "async": "dashed", "dotted": "dotted"}
EDGE_STROKES = {"default": (1.5, ()), "emphasis": (1.8, ()), "security": (1.5, (5, 5)), "dashed": (1.5, (4, 4)), "dotted": (1.4, (1.5, 4))}
ANIMATED, STRONG_USES = "animated", 20
LOCALES = ("tr", "ar", "en")

# Which relation wins among equally frequent ones.
RELATION_RANK = {"Calls": 5, "DependsOn": 6, "Reads": 6, "Writes": 6, "Transforms": 6, "Produces": 6, "Imports": 4, "Implements": 3, "Extends": 2, "References": 1, "Contains": 0}
#: Order of the relations, for what the rank leaves open.
RELATION_ORDER = ("Calls", "Extends", "Implements", "Contains", "Imports", "References", "DependsOn", "Reads", "Writes", "Transforms", "Produces")

# Words that tell a role, in the order in which roles are tried.
ROLE_WORDS = {
    "Security": "auth token crypto security secret guvenlik güvenlik kimlik anahtar kasa",
    "Database": "db sql sqlite database storage store cache index indeks veri veritabani depolama onbellek depo",
    "Messagebus": "bus queue event events stream pipe spool watcher olay kuyruk boru izleyici",
    "Frontend": "ui gui tui egui view views web frontend client page pages components theme cli cmd bin pencere arayuz arayüz ekran panel tema tuval canvas",
    "Cloud": "cloud aws gcp azure mesh uzak",
    "External": "external vendor sdk ext thirdparty",
}
GUI_PACKAGES = ("egui", "eframe", "tauri", "iced", "slint", "ratatui", "dioxus", "leptos")
ROLE_ORDER = ("Frontend", "Backend", "Database", "Cloud", "Security", "Messagebus", "External")

# Status words of goal boards.
STATUS_WORDS = {
    "done": "passing done tamam bitti complete completed",
    "partial": "partial kismi",
    "active": "in_progress in-progress devam doing active",
    "pending": "pending todo bekliyor queued",
    "deferred": "deferred ertelendi wontdo wont_do",
}
UNREADABLE = "unreadable"


def pick(locale: str, labels: tuple[str, str, str]) -> str:
    return labels[LOCALES.index(locale)] if locale in LOCALES else labels[2]


def relation_label(relation: Column, locale: str) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in RELATION_LABELS.items() for x in (k, pick(locale, v))])
    return F.element_at(table, relation)


def uses_label(uses: Column, locale: str) -> Column:
    return F.when(uses == 0, pick(locale, DEPENDS)).otherwise(F.format_string(pick(locale, USES), uses))


def counts_label(files: Column, symbols: Column, locale: str) -> Column:
    return F.format_string(pick(locale, COUNTS), files, symbols)


def relation_rank(relation: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in RELATION_RANK.items() for x in (k, v)]), relation)


def relation_place(relation: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in RELATION_ORDER]), relation)


def words(name: Column) -> Column:
    """Folded whole words."""
    return F.filter(F.split(T.fold_tr(name), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def role_of(name: Column) -> Column:
    """The first role one of whose words is a whole word of the name, or null."""
    found = F.lit(None).cast("string")
    for role, listed in reversed(ROLE_WORDS.items()):
        found = F.when(F.arrays_overlap(words(name), F.array(*[T.fold_tr(F.lit(w)) for w in listed.split()])), role).otherwise(found)
    return found


def role_for(module: Column, region: Column) -> Column:
    return F.coalesce(role_of(module), role_of(region), F.lit("Backend"))


def role_for_package(name: Column, deps: Column, bin_only: Column, has_dependents: Column) -> Column:
    gui = F.arrays_overlap(deps, F.array(*[F.lit(d) for d in GUI_PACKAGES]))
    entry = ~has_dependents & (bin_only | F.array_contains(deps, "clap"))
    return F.coalesce(role_of(name), F.when(gui | entry, "Frontend").otherwise("Backend"))


def status_of(word: Column) -> Column:
    """State of a status word; what is unknown or missing is unreadable, never done."""
    table = F.create_map(*[F.lit(x) for state, listed in STATUS_WORDS.items() for w in listed.split() for x in (w, state)])
    return F.coalesce(F.element_at(table, T.fold_tr(F.trim(word))), F.lit(UNREADABLE))


def edge_kind(style: Column) -> Column:
    """Kind of a line style, whatever its case; what is unknown is a plain line."""
    table = F.create_map(*[F.lit(x) for k, v in EDGE_KINDS.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(table, F.lower(style)), F.lit("default"))
