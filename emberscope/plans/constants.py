"""Fixed values binding the pipeline to the supplied tables.

The words occur in the supplied documents; the intervals cover part of the
period of the supplied events and include unusable ones on purpose.
"""

POSITIVE_WORDS = ["and", "to", "der", "et", "la"]
NEGATIVE_WORDS = ["is", "that", "und", "les", "que"]
SUBSTRING_LEXICON = [
    ("tion", -1), ("and", 1), ("ing", 1), ("that", -1), ("eau", 1),
    ("les", -1), ("und", -1), ("der", 1), ("hat", -1), ("la", 1),
]
# topic, position, start, end, label, description
INTERVALS = [
    ("error", 1, "2024-01-05 00:00:00", "2024-01-07 12:00:00", "outage", "first wave"),
    ("error", 2, "2024-01-20 00:00:00", "2024-01-21 00:00:00", None, None),
    ("error", 3, "2024-01-06 00:00:00", "2024-01-08 00:00:00", "overlap", None),
    ("click", 1, "2024-01-10 00:00:00", "2024-01-11 00:00:00", "campaign", ""),
    ("view", 1, "2024-01-15 00:00:00", "2024-01-14 00:00:00", "inverted", None),
    ("signup", 1, "2024-01-15 00:00:00", None, "open", None),
    ("purchase", 1, "soon", "2024-01-14 00:00:00", "unreadable", None),
]
# Rule scores standing in for classifier probabilities, as SQL over volume_norm etc.
EVAL_MODELS = {
    "blend": "least(1.0, volume_norm * 0.5 + negative_rate * 0.5)",
    "negativity": "negative_rate",
    "criticism": "stance_against_rate",
    "surge": "volume_norm",
    "composite": "volume_norm * negative_rate * stance_against_rate",
}
