"""Word tables the operators take as parameters, with the values used when the caller passes none."""

from __future__ import annotations

# Function words of English. Callers with another list (for instance the one of
# ``StopWordsRemover.loadDefaultStopWords``) pass it to ``stop_words`` instead.
ENGLISH_STOP_WORDS = tuple(
    """
    a about above across after again against ain all almost along already also although always am among an and
    another any anyone anything are aren around as at back be became because become been before behind being below
    between both but by can cannot could couldn did didn do does doesn doing don done down during each either else
    enough ever every everyone everything few for from further had hadn has hasn have haven having he her here hers
    herself him himself his how however i if in into is isn it its itself ll may me might mine more most mostly much
    must mustn my myself needn neither never no nobody none nor not nothing now of off often on once only or other
    others our ours ourselves out over own per perhaps please put quite rather re s same shall shan she should
    shouldn since so some someone something such t than that the their theirs them themselves then there these they
    this those though through thus to together too toward under until up upon us ve very was wasn we well were weren
    what when where whether which while who whom whose why will with within without won wouldn yet you your yours
    yourself yourselves
    """.split()
)

# Shop words removed from every token list.
SHOP_STOP_WORDS = (
    "product", "amazon", "item", "buy", "purchase", "order", "ship",
    "shipping", "seller", "price", "review", "star", "rating", "got",
    "get", "use", "used", "using", "would", "could", "also", "one",
    "two", "three", "four", "five", "really", "just", "even", "still",
)

# Generic words removed from the topic model's input only.
TOPIC_STOP_WORDS = (
    "product", "amazon", "item", "buy", "purchase", "order",
    "get", "got", "use", "used", "good", "great", "nice", "bad",
    "really", "just", "like", "love", "hate", "work", "make",
    "thing", "come", "going", "say", "know", "think", "want",
    "need", "look", "give", "take", "little", "big", "new", "old",
)

# A small form -> lemma table; forms outside it are their own lemma.
LEMMAS = {
    "batteries": "battery", "books": "book", "bought": "buy", "broke": "break", "broken": "break",
    "cameras": "camera", "charged": "charge", "charges": "charge", "charging": "charge", "children": "child",
    "colors": "color", "devices": "device", "downloaded": "download", "downloads": "download", "enjoyed": "enjoy",
    "enjoys": "enjoy", "features": "feature", "fits": "fit", "games": "game", "gave": "give", "gifts": "gift",
    "hours": "hour", "kids": "kid", "lasted": "last", "lasts": "last", "liked": "like", "likes": "like",
    "loved": "love", "loves": "love", "loving": "love", "made": "make", "movies": "movie", "needed": "need",
    "needs": "need", "phones": "phone", "pictures": "picture", "played": "play", "playing": "play", "plays": "play",
    "problems": "problem", "readers": "reader", "reading": "read", "reads": "read", "recommended": "recommend",
    "returned": "return", "screens": "screen", "sizes": "size", "sounds": "sound", "speakers": "speaker",
    "stopped": "stop", "tablets": "tablet", "things": "thing", "took": "take", "videos": "video", "wanted": "want",
    "wants": "want", "watched": "watch", "watching": "watch", "went": "go", "worked": "work", "working": "work",
    "works": "work", "years": "year",
}

# Starting lexicon: word -> valence in tenths, positive above zero. Most values follow the public lexicon of Hutto and
# Gilbert (2014, MIT licence), rounded to tenths; it is a sample, pass the full table as a parameter.
LEXICON = {
    "amazing": 28, "awesome": 31, "beautiful": 29, "best": 32, "better": 19, "bright": 19, "charming": 28,
    "comfortable": 23, "convenient": 17, "cute": 20, "delighted": 23, "durable": 15, "easy": 19, "enjoy": 22,
    "enjoyable": 19, "excellent": 27, "fabulous": 24, "fantastic": 26, "fast": 12, "fine": 8, "flawless": 23,
    "free": 23, "friendly": 22, "fun": 23, "glad": 20, "good": 19, "gorgeous": 30, "great": 31, "happy": 27,
    "helpful": 18, "impressed": 21, "impressive": 23, "incredible": 26, "interesting": 17, "like": 15, "liked": 18,
    "likes": 18, "love": 32, "loved": 29, "lovely": 28, "loves": 27, "nice": 18, "outstanding": 30, "perfect": 27,
    "perfectly": 32, "pleasant": 23, "pleased": 19, "reliable": 18, "recommend": 15, "safe": 19, "satisfied": 18,
    "sturdy": 14, "super": 29, "superb": 31, "thank": 15, "thanks": 19, "useful": 19, "win": 28, "wonderful": 27,
    "worth": 9, "wow": 28,
    "angry": -23, "annoyed": -16, "annoying": -17, "awful": -20, "bad": -25, "boring": -13, "broke": -18,
    "broken": -21, "cheap": -7, "clown": -16, "complain": -15, "complaint": -12, "confusing": -13, "crap": -16,
    "damage": -22, "damaged": -19, "dead": -33, "defective": -19, "difficult": -15, "disappointed": -21,
    "disappointing": -22, "disgusting": -24, "error": -17, "fail": -25, "failed": -23, "fails": -18, "fake": -21,
    "fault": -17, "faulty": -13, "frustrated": -24, "frustrating": -19, "garbage": -20, "hate": -27, "hated": -32,
    "horrible": -25, "idiot": -23, "junk": -17, "lame": -18, "loser": -24, "mess": -15, "miserable": -22,
    "moron": -22, "nasty": -26, "noisy": -7, "pathetic": -27, "poor": -21, "poorly": -19, "problem": -17,
    "problems": -17, "sad": -21, "scam": -27, "scum": -24, "slow": -8, "stupid": -24, "terrible": -21,
    "trash": -15, "trouble": -17, "ugly": -23, "unhappy": -18, "unusable": -18, "upset": -16, "useless": -18,
    "vile": -31, "warning": -14, "waste": -18, "weak": -19, "worse": -21, "worst": -31, "worthless": -19,
    "wrong": -21,
}

# Degree words: word -> step in thousandths, added in the direction of the valence they precede.
BOOSTERS = {
    "absolutely": 293, "amazingly": 293, "awfully": 293, "completely": 293, "considerably": 293, "decidedly": 293,
    "deeply": 293, "enormously": 293, "entirely": 293, "especially": 293, "exceptionally": 293, "extremely": 293,
    "fully": 293, "greatly": 293, "highly": 293, "hugely": 293, "incredibly": 293, "intensely": 293, "more": 293,
    "most": 293, "particularly": 293, "purely": 293, "quite": 293, "really": 293, "remarkably": 293, "so": 293,
    "substantially": 293, "thoroughly": 293, "totally": 293, "tremendously": 293, "unbelievably": 293,
    "unusually": 293, "utterly": 293, "very": 293,
    "almost": -293, "barely": -293, "hardly": -293, "kinda": -293, "less": -293, "little": -293, "marginally": -293,
    "occasionally": -293, "partly": -293, "scarcely": -293, "slightly": -293, "somewhat": -293, "sorta": -293,
}

# Negators. Cleaned text has no apostrophes, so only the joined and the plain forms can occur.
NEGATORS = (
    "aint", "arent", "cannot", "cant", "couldnt", "despite", "didnt", "doesnt", "dont", "hadnt", "hasnt", "havent",
    "isnt", "mightnt", "mustnt", "neednt", "neither", "never", "none", "nope", "nor", "not", "nothing", "nowhere",
    "rarely", "seldom", "shouldnt", "uhuh", "wasnt", "werent", "without", "wont", "wouldnt",
)
CONTRAST_WORD = "but"

# Fixed values of the published rule set: phrases with a valence of their own, in tenths, and two-word degree phrases.
IDIOMS = {
    "the shit": 30, "the bomb": 30, "bad ass": 15, "bus stop": 0, "yeah right": -20, "kiss of death": -15, "to die for": 30,
}
PHRASE_STEPS = {"kind of": -293, "sort of": -293, "just enough": -293}

# Classes of closed words, an authored selection.
CLOSED_CLASSES = {
    word: tag
    for tag, words in {
        "DET": "a an the this that these those each every some any no",
        "PRON": "i you he she it we they me him her us them who which myself itself",
        "ADP": "of in on at by for with from to into over under after before about against between through during without",
        "CONJ": "and or but nor so yet because although while if than as",
        "VERB": "is are was were be been am do does did has have had can could will would shall should may might must",
        "ADV": "not very too also just only even still never always often here there then now",
    }.items()
    for word in words.split()
}

# Suffixes that tell the class of a longer word.
SUFFIX_CLASSES = {
    "ly": "ADV", "ing": "VERB", "ed": "VERB", "tion": "NOUN", "ment": "NOUN", "ness": "NOUN", "ity": "NOUN", "er": "NOUN",
    "ous": "ADJ", "ful": "ADJ", "able": "ADJ", "ive": "ADJ", "less": "ADJ",
}
