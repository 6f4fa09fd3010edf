"""Word and file lists of the token policy."""

# English stop words, down-weighted in scoring and never removed.
STOP_WORDS = (
    "a", "about", "above", "after", "again", "against", "ain", "all", "am", "an", "and", "any", "are", "aren",
    "aren't", "as", "at", "be", "because", "been", "before", "being", "below", "between", "both", "but", "by",
    "can", "couldn", "couldn't", "d", "did", "didn", "didn't", "do", "does", "doesn", "doesn't", "doing", "don",
    "don't", "down", "during", "each", "few", "for", "from", "further", "had", "hadn", "hadn't", "has", "hasn",
    "hasn't", "have", "haven", "haven't", "having", "he", "he'd", "he'll", "he's", "her", "here", "hers",
    "herself", "him", "himself", "his", "how", "i", "i'd", "i'll", "i'm", "i've", "if", "in", "into", "is",
    "isn", "isn't", "it", "it'd", "it'll", "it's", "its", "itself", "just", "ll", "m", "ma", "me", "mightn",
    "mightn't", "more", "most", "mustn", "mustn't", "my", "myself", "needn", "needn't", "no", "nor", "not",
    "now", "o", "of", "off", "on", "once", "only", "or", "other", "our", "ours", "ourselves", "out", "over",
    "own", "re", "s", "same", "shan", "shan't", "she", "she'd", "she'll", "she's", "should", "should've",
    "shouldn", "shouldn't", "so", "some", "such", "t", "than", "that", "that'll", "the", "their", "theirs",
    "them", "themselves", "then", "there", "these", "they", "they'd", "they'll", "they're", "they've", "this",
    "those", "through", "to", "too", "under", "until", "up", "ve", "very", "was", "wasn", "wasn't", "we",
    "we'd", "we'll", "we're", "we've", "were", "weren", "weren't", "what", "when", "where", "which", "while",
    "who", "whom", "why", "will", "with", "won", "won't", "wouldn", "wouldn't", "y", "you", "you'd", "you'll",
    "you're", "you've", "your", "yours", "yourself", "yourselves",
)

# Words that always count more.
NEVER_FILTER = (
    "accessibility", "accessible", "a11y", "wcag", "screen-reader", "screenreader", "voiceover", "talkback",
    "tts", "text-to-speech", "aria", "alt", "alt-text", "contrast", "keyboard", "focus", "caption", "captions",
    "subtitle", "subtitles", "transcript",
)

# Words that keep their full weight in source code.
CODE_IMPORTANT = (
    "if", "else", "for", "while", "switch", "case", "break", "continue", "return", "null", "true", "false",
    "import", "export", "class", "interface", "abstract", "extends", "implements", "factory", "const", "final",
    "static", "async", "await", "future", "void", "int", "double", "string", "bool", "list", "map", "set",
    "try", "catch", "throw", "json", "yaml", "xml", "sql",
)

# File name extensions and file names of the code domain.
CODE_EXTENSIONS = (
    ".dart", ".py", ".js", ".ts", ".java", ".kt", ".kts", ".swift", ".cpp", ".cc", ".cxx", ".c", ".h", ".hpp",
    ".cs", ".go", ".rs", ".php", ".rb", ".scala", ".sh", ".bash", ".ps1", ".sql", ".html", ".css", ".scss",
    ".xml", ".json", ".yaml", ".yml", ".toml", ".ini", ".gradle",
)
CODE_FILE_NAMES = (
    "pubspec.yaml", "package.json", "tsconfig.json", "dockerfile", "makefile", "cmakelists.txt",
    "requirements.txt",
)

# Token weights.
WEIGHT_NEVER, WEIGHT_CODE, WEIGHT_FREQUENT, WEIGHT_STOP, WEIGHT_DEFAULT = 1.5, 1.0, 0.10, 0.15, 1.0
FREQUENT_RATIO = 0.90
