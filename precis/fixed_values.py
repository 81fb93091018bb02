"""Constants that define the results and therefore must not change."""

# --- fixed values -------------------------------------------------------------------------------

# Sentences read per document when building a labelled training set.
MAX_SENTENCES_PER_DOC = 120
# A sentence shorter than this many characters is glued to the one before it.
MIN_SENTENCE_CHARS = 40
# Whitespace tokens: shortest transcript kept, section size, and the range sampled for annotation.
MIN_TRANSCRIPT_TOKENS = 100
SECTION_WORDS = 400
SAMPLE_TOKEN_RANGE = (300, 2500)
SAMPLES_PER_TOPIC = 3
# Positive sentences per document, by overlap (ROUGE-L) and by TF-IDF cosine.
TOP_K_ROUGE = 5
TOP_K_COSINE = 10
# Largest vocabulary of the 1-2-gram features.
MAX_FEATURES = 10_000
SEED = 42
TEST_FRACTION = 0.2
# Cut-offs that turn a score into a label.
LINREG_THRESHOLD = 0.5
FFN_THRESHOLD = 0.35
# Lengths of the padded id sequences.
INPUT_LENGTH = 512
TARGET_LENGTH = 128

# Ordered keyword rules: the first rule with a keyword contained in the lower-cased playlist name wins.
TOPIC_RULES = [
    ("NLP", [
        "natural language processing", "nlp", "transformer", "bert", "spacy", "hugging face",
    ]),
    ("RL", ["reinforcement learning", "rl ", "rl -"]),
    ("ML/Deep Learning", [
        "machine learning", "deep learning", "neural network", "cs229", "cs230", "cs221", "cs234",
        "ml tech talks", "mit advanced machine learning", "advanced deep learning",
        "deep learning course", "deep learning basics", "practical deep learning",
        "deep learning fundamentals", "intro to deep learning", "deep learning from the foundations",
    ]),
    ("AI: General/Papers", [
        "artificial intelligence", "ai ", "ai-", "ai,", "ai:", "age of a.i.", "two minute papers",
        "papers explained", "ai explained", "cognitive and ai", "deep learning research papers",
    ]),
    ("DS/Stats", [
        "data science", "pydata", "scipy", "tabular data", "practical statistics",
        "data engineering", "linear algebra", "data analysis", "pandas tutorial",
        "free data science course", "python data analysis",
    ]),
    ("Programming/Python", [
        "python", "django", "flask", "pytorch", "tensorflow", "matplotlib",
        "modules and libraries", "projects", "programming", "web scraping", "beautiful soup",
    ]),
    ("Podcast/Talk", ["podcast", "deepmind: the podcast", "lex fridman", "our story"]),
]
OTHER_TOPIC = "Other"

# Chat request for an abstractive summary (the missing space in the prompt is part of the value).
SUMMARY_PROMPT = (
    "You are a helpful assistant that writes concise, factualsummaries of Text. "
    "Limit the summary to around 4 sentences."
)
CHAT_TEMPERATURE = 0.2
CHAT_MAX_TOKENS = 256
