"""Word lists, bins and parameters that define the results."""

# Fixed values. They are part of the definition of each measure, so they stand here as they are.

#: Function words of the style profile; one of them is listed twice, which changes nothing.
FUNCTION_WORDS = [
    "the", "be", "to", "of", "and", "a", "in", "that", "have", "i", "it", "for", "not", "on", "with", "he", "as",
    "you", "do", "at", "this", "but", "his", "by", "from", "they", "we", "her", "she", "or", "an", "will", "my",
    "one", "all", "would", "there", "their", "what", "so", "up", "out", "if", "about", "who", "get", "which", "go",
    "me", "when", "make", "can", "like", "no", "just", "him", "know", "take", "could", "them", "than", "other",
    "been", "now", "its", "also", "after", "very", "then", "our", "into", "well", "some", "had", "only", "how",
    "has", "may", "more", "over", "such", "any", "most", "each", "much", "both", "where", "being", "while",
    "through", "before", "between", "own", "these", "those", "even", "because", "way", "still", "here", "should",
    "many", "must", "under", "since", "might", "yet", "us", "same", "though", "did", "too", "every", "until",
    "around", "without", "again", "why", "few", "never", "were", "was", "are", "is", "am", "been", "done", "does",
    "got", "shall", "during", "another", "off", "down", "let", "once", "already", "almost", "always", "nor",
    "either", "neither", "whether", "nothing", "himself", "herself", "itself", "themselves", "something",
    "anything", "everything", "someone", "anyone", "everyone", "whom", "whose", "upon", "thus", "hence",
    "therefore", "however", "although", "moreover", "furthermore", "nevertheless", "whereas", "whereby", "wherein",
    "perhaps", "indeed", "rather", "quite", "somewhat", "enough", "within", "among", "against", "above", "below",
    "beside", "beyond", "throughout", "toward", "towards", "onto", "except", "along", "across", "behind", "beneath",
]

#: Words and phrases of formulaic prose.
BANNED_WORDS = [
    "delve", "tapestry", "landscape", "leverage", "nuance", "multifaceted", "holistic", "pivotal", "realm",
    "foster", "encompass", "underscore", "embark", "navigate", "robust", "vibrant", "comprehensive", "paramount",
    "intricate", "resonate", "furthermore", "moreover", "nevertheless", "harnessing", "synergy", "paradigm",
    "ecosystem", "streamline", "cutting-edge", "innovative", "game-changer", "groundbreaking", "transformative",
    "revolutionize", "spearhead", "catalyze", "galvanize", "facilitate", "bolster", "augment", "exacerbate",
    "juxtapose", "illuminate", "elucidate", "delineate", "unpack", "unravel", "dovetail", "interplay", "symbiosis",
    "confluence", "cornerstone", "linchpin", "bedrock", "underpinning", "scaffolding", "blueprint", "roadmap",
    "trajectory", "endeavor", "endeavour", "myriad", "plethora", "diverse", "proactive", "stakeholder", "optimize",
    "utilize", "implement", "framework",
]

BANNED_PHRASES = [
    "deep dive", "double-edged sword", "at the end of the day", "it's worth noting", "in today's world",
    "in the realm of", "it is important to note", "this is a testament to", "a testament to", "the landscape of",
    "the tapestry of", "in the ever-evolving", "it cannot be overstated", "serves as a reminder",
    "it is crucial to", "plays a pivotal role", "a multifaceted approach", "a holistic approach",
    "the intersection of", "when it comes to", "at its core", "by the same token", "in light of",
    "a nuanced understanding", "a comprehensive overview", "this underscores the", "it bears mentioning",
    "the broader implications", "a paradigm shift",
]

#: Banned words that an author may well use.
AUTHOR_VALID = [
    "furthermore", "moreover", "nevertheless",
]

#: Words that no lexicon term may be.
LEXICON_STOPWORDS = [
    "the", "a", "an", "is", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "may", "might", "shall", "can", "need", "dare", "ought", "used", "to", "of", "in",
    "for", "on", "with", "at", "by", "from", "as", "into", "through", "during", "before", "after", "above", "below",
    "between", "out", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where",
    "why", "how", "all", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only",
    "own", "same", "so", "than", "too", "very", "just", "because", "but", "and", "or", "if", "while", "that",
    "this", "these", "those", "it", "its", "he", "she", "they", "them", "his", "her", "their", "what", "which",
    "who", "whom", "whose", "we", "you", "your", "my", "our", "me", "him", "us", "i", "about", "up", "also", "said",
    "one", "two", "even", "much", "many", "well", "back", "still", "going", "really", "something", "nothing",
    "everything", "anything", "thing", "things", "like", "know", "think", "make", "take", "come", "go", "see",
    "look", "want", "give", "get", "say", "tell", "new", "good", "first", "last", "long", "great", "little",
    "right", "old", "big", "high", "small", "large", "next", "young", "important", "few", "public", "bad", "man",
    "woman", "time", "year", "people", "way", "day", "world", "life", "hand", "part", "place", "case", "week",
    "company", "system", "program", "question", "work", "government", "number", "night", "point", "home", "water",
    "room",
]

#: Words that carry no content of a prompt.
PROMPT_STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "this", "that", "these", "those", "it", "its", "i", "you", "he",
    "she", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his", "our", "their", "what", "which",
    "who", "whom", "how", "when", "where", "why", "not", "no", "so", "if", "about", "up", "out", "just", "than",
    "then", "also", "very", "some", "any", "all", "each", "every", "into", "as", "write", "writing", "paragraph",
    "essay", "piece", "about", "describe", "explain", "tell",
]

#: Abbreviations: before a name; inside a sentence; such that may end one.
STRONG_ABBREVIATIONS = [
    "mr", "mrs", "ms", "mx", "dr", "prof", "rev", "fr", "sr", "jr", "capt", "lt", "col", "gen", "sgt", "cpl", "pvt",
    "st", "mt", "messrs", "mme", "mlle",
]
INTERNAL_ABBREVIATIONS = [
    "eg", "ie", "cf", "viz", "approx", "dept", "govt", "no", "nos", "vol", "vols", "pp", "ch", "fig", "figs", "sec",
    "ed", "eds", "inc", "ltd", "corp", "assn",
]
WEAK_ABBREVIATIONS = [
    "etc", "vs", "am", "pm",
]

#: Query parameters that only track.
TRACKING_PARAMETERS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref"]

#: Sentence lengths, in words: lower edges of the histogram's bins (the last is open) and their centres.
HISTOGRAM_EDGES = [1, 3, 5, 7, 9, 11, 14, 18, 25, 35, 50]
HISTOGRAM_CENTERS = [1.5, 3.5, 5.5, 7.5, 9.5, 12.0, 15.5, 21.0, 29.5, 42.0, 60.0]

#: Weights of the parts of the style distance.
DISTANCE_WEIGHTS = {
    "function_words": 0.25,
    "ngrams": 0.20,
    "sentences": 0.15,
    "terminal": 0.10,
    "structural": 0.10,
    "readability": 0.10,
    "richness": 0.10,
}
