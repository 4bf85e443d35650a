"""Word lists, cues and constants that fix the meaning of the text operators."""

# English function words and request words that carry no retrieval signal.
FUNCTION_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "i", "in", "is", "it", "me", "my", "of", "on", "or",
    "please", "some", "that", "the", "this", "to", "want", "with", "would", "you", "looking",
)
# Request words.
REQUEST_WORDS = (
    "actually", "anything", "buy", "buying", "find", "forget", "get", "give", "hello", "hey", "hi", "instead", "need", "needs",
    "nevermind", "purchase", "recommend", "scratch", "show", "shopping", "something", "suggest", "thanks", "thank", "mind",
    "never", "nope", "wait", "key", "requirement", "requirements", "matters", "what", "preference", "additional", "specific",
    "attribute", "options", "yet", "quite", "ignore", "earlier", "judgment", "judgement",
)
STOPWORDS = FUNCTION_WORDS + REQUEST_WORDS

# Spellings and what they become.
SPELLINGS = {
    "jewellery": "jewelry", "jewelery": "jewelry", "jewellry": "jewelry", "colour": "color", "colours": "colors",
    "coloured": "colored", "favourite": "favorite", "favourites": "favorites",
}

# Materials of catalog extraction, in order of preference.
CATALOG_MATERIALS = (
    "cotton", "polyester", "nylon", "leather", "wool", "spandex", "silk", "rayon", "denim", "suede", "canvas", "linen",
    "cashmere", "fleece", "mesh", "velvet", "lace", "rubber", "sterling silver", "stainless steel", "metal",
)
# Colors of catalog extraction and messages.
COLORS = (
    "black", "white", "blue", "red", "pink", "green", "brown", "gray", "grey", "purple", "yellow", "orange", "navy", "beige",
    "tan", "gold", "silver", "multicolor",
)
# The shorter list that messages are searched for.
MESSAGE_MATERIALS = CATALOG_MATERIALS[:16]
# The lists of the simulated customer.
CUSTOMER_MATERIALS = ("cotton", "polyester", "nylon", "leather", "wool", "spandex", "silk", "rayon", "fabric")
CUSTOMER_COLORS = ("black", "white", "blue", "red", "pink", "green", "brown", "gray", "grey", "purple", "yellow", "orange")

# Words of amounts.
UNITS = {w: i + 1 for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * (i + 2) for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split())}
# Cues for a lower bound, and negated ones that mean an upper bound.
FLOOR_CUES = ("over", "above", "at least", "more than", "starting at", "no less than", "upwards of")
NEGATED_FLOOR_CUES = (
    "no more than", "not more than", "no higher than", "not higher than", "no greater than", "nothing over", "nothing above",
    "not over", "not above", "no over",
)

# How many characters before a match a negation may stand.
NEGATION_WINDOW = 20
# Answerability at the start of a session, and odds ratios after an answer.
ANSWERABILITY = {"feature": 0.960, "material": 0.725, "color": 0.255, "style": 0.085, "size": 0.045, "use_case": 0.020, "budget": 0.001}
ANSWER_ODDS = {
    "material": {"color": 0.209, "style": 0.136, "size": 0.113, "use_case": 0.156},
    "color": {"material": 0.209, "style": 2.89, "size": 2.489, "use_case": 1.243},
    "style": {"material": 0.136, "color": 2.89, "size": 1.877, "use_case": 4.688},
}
# Ranking constants.
BM25_K1, BM25_B = 1.2, 0.75
FIELD_WEIGHTS = {"title": 6.0, "categories": 4.0, "features": 2.5, "details": 2.5, "store": 0.0, "description": 1.0}
MAX_QUERY_TERMS, MAX_GRAMS, MAX_GRAM_DOCS, GRAM_SIZES = 40, 24, 150, (6, 5, 4, 3, 2)
RRF_K = 60
PRF_DOCS, PRF_TERMS, PRF_LEAST_DF, PRF_LEAST_LENGTH = 10, 8, 3, 3
CATEGORY_LEAST_DF, ROOT_SAMPLE, ROOT_SHARE = 20, 1000, 0.95
MAX_TURNS, TOP_K = 10, 10
# Labels that say whom a product is for, and generic labels of category paths.
DEMOGRAPHIC_WORDS = ("women", "men", "girls", "boys", "baby", "kids", "unisex", "adult", "novelty")
GENERIC_CATEGORIES = ("clothing", "clothing shoes & jewelry", "clothing, shoes & jewelry")
# What may be asked, the questions, and what is said without one.
ASKABLE = ("category", "material", "color", "size", "style", "brand", "budget", "feature", "use_case", "other")
QUESTIONS = {
    "material": "What material are you looking for?",
    "color": "Do you have a color preference?",
    "style": "Any particular style or fit you'd like?",
    "size": "What size do you need?",
    "use_case": "What will you be using this for?",
    "budget": "Do you have a budget in mind?",
    "feature": "Is there a specific feature that matters most to you?",
}
NO_QUESTION = "Here are the closest matches I found so far."
# An attribute counts as exhausted below this, and prototypes and similarity of a non-answer.
EXHAUSTED, TOP_PROTOTYPES, NON_ANSWER_SIMILARITY = 0.0005, 4, 0.68
# Attributes whose entropy can be measured, in order.
STRUCTURAL = ("material", "color")
