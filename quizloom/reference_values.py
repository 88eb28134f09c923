"""Fixed values of the exam: blueprint, formats, chapter names, limits, thresholds."""

from __future__ import annotations

# Fixed values: (chapter key, least questions, most questions, easy, medium, hard) in blueprint order.
BLUEPRINT = [
    ("chapter_01_introduction_to_computer", 8, 10, 0.5, 0.35, 0.15),
    ("chapter_02_operating_system", 6, 8, 0.5, 0.35, 0.15),
    ("chapter_03_word_processing", 15, 18, 0.4, 0.4, 0.2),
    ("chapter_04_spreadsheet", 12, 15, 0.4, 0.4, 0.2),
    ("chapter_05_presentation", 5, 7, 0.5, 0.35, 0.15),
    ("chapter_06_internet_www", 10, 12, 0.4, 0.4, 0.2),
    ("chapter_07_email_social_egov", 10, 12, 0.4, 0.4, 0.2),
    ("chapter_08_digital_financial_tools", 10, 13, 0.35, 0.45, 0.2),
    ("chapter_09_futureskills_cybersecurity", 12, 15, 0.35, 0.45, 0.2),
]
SET_SIZE = 100

# Share of every question type in a chapter's batch.
FORMAT_MIX = [
    ("standard", 0.35),
    ("assertion_reason", 0.10),
    ("statement_based", 0.15),
    ("scenario_based", 0.15),
    ("fill_blank", 0.10),
    ("match_following", 0.08),
    ("sequence_order", 0.07),
]

# Chapter titles of the book, by chapter number, and its back matter.
BOOK_TITLES = [
    "1. INTRODUCTION TO COMPUTER",
    "2. INTRODUCTION TO OPERATING SYSTEM",
    "3. WORD PROCESSING",
    "4. SPREAD SHEET",
    "5. PRESENTATION",
    "6. INTRODUCTION TO INTERNET AND WWW",
    "7. E-MAIL, SOCIAL NETWORKING AND",
    "8. DIGITAL FINANCIAL TOOLS",
    "9. OVERVIEW OF FUTURESKILLS",
]
BACK_MATTER = [
    "Computer Abbreviations",
    "Computer Glossary",
    "Practice Set 1",
    "Practice Set 2",
    "Practice Set 3",
    "Practice Set 4",
    "Practice Set 5",
]

# Chapter short ids and their snake-case names.
CHAPTER_IDS = [
    ("ch1", "introduction_to_computer"),
    ("ch2", "introduction_to_operating_system"),
    ("ch3", "word_processing"),
    ("ch4", "spreadsheet"),
    ("ch5", "presentation"),
    ("ch6", "internet_www"),
    ("ch7", "email_social_egov"),
    ("ch8", "digital_financial_tools"),
    ("ch9", "futureskills_cybersecurity"),
]

# Display names of chapters, first hit wins, with their chapter number.
CHAPTER_ALIASES = [
    ("Introduction to Computer", 1),
    ("Introduction to Computer System", 1),
    ("Operating System", 2),
    ("Introduction to Operating System", 2),
    ("Word Processing", 3),
    ("Spreadsheet", 4),
    ("Presentation", 5),
    ("Introduction to Internet and WWW", 6),
    ("Email, Social Networking and e-Governance Services", 7),
    ("Digital Financial Tools", 8),
    ("Digital Financial Tools and Applications", 8),
    ("Overview of Futureskills and Cyber Security", 9),
    ("Overview of Future Skills and Cyber Security", 9),
    ("FutureSkills and Cybersecurity", 9),
    ("Overview of FutureSkills and Cyber Security", 9),
    ("Overview of Futureskills & Cyber Security", 9),
]

# Bloom levels that fit a difficulty, and the one assumed without a classifier.
BLOOM_FOR = {
    "easy": ["remember", "understand"],
    "medium": ["understand", "apply"],
    "hard": ["apply", "analyze"],
}
BLOOM_DEFAULT = {"easy": "remember", "medium": "understand", "hard": "apply"}

# Words that speak for an easy (at the start) or hard (anywhere) question.
EASY_SIGNALS = [
    "what is", "which of", "define", "full form", "stands for",
    "example of", "used for", "is used to", "is called",
]
HARD_SIGNALS = [
    "calculate", "formula", "which formula", "result of",
    "sequence", "order", "step", "advanced", "configure",
]
CLASSIFIED_TYPES = ["assertion_reason", "scenario_based", "sequence_order"]
FIXED_OPTION_TYPES = ["assertion_reason", "sequence_order"]

# Terms outside the course.
OUT_OF_SCOPE = [
    "java programming", "c++", "data structures", "compiler design",
    "operating system kernel", "assembly language",
]

# Fixed values: (metric, warn limit, critical limit, lower is better).
METRIC_LIMITS = [
    ("question_accuracy", 98.0, 95.0, False),
    ("answer_accuracy", 99.0, 97.0, False),
    ("rejection_rate", 5.0, 10.0, True),
    ("semantic_uniqueness", 95.0, 90.0, False),
    ("concept_overlap", 5.0, 10.0, True),
    ("difficulty_balance", 90.0, 80.0, False),
    ("bloom_accuracy", 90.0, 80.0, False),
]

# Phrases that vary the retrieval query from set to set.
SEED_PHRASES = [
    "concepts definitions facts",
    "applications uses examples",
    "features components types",
    "operations procedures steps",
    "advantages disadvantages comparison",
    "history evolution development",
    "security protocols standards",
    "tools software hardware",
    "networking communication data",
    "management organisation structure",
]

# Topic slug -> (home chapter, other chapters that share it).
CROSS_REFERENCES = [
    ("shortcut_keys_writer", "ch3", ["ch4", "ch5"]),
    ("save_document", "ch3", ["ch4", "ch5"]),
    ("tables_in_writer", "ch3", ["ch5"]),
    ("cloud_computing_basics", "ch6", ["ch9"]),
    ("irctc_railway", "ch7", []),
    ("cyber_safety_email", "ch7", ["ch9"]),
    ("iot_basics", "ch6", ["ch9"]),
]
