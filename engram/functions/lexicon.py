"""Word lists, weights and positions that results depend on."""

# --- accents (fixed values) -------------------------------------------------------------------
# letters with a combining mark, as they appear in the supported languages, and their base letters
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŸ"
UNACCENTED = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYY"

# --- sparse vector positions (fixed values) ----------------------------------------------------
STATE_POSITIONS = {
    1: "emotion_valence",
    2: "emotion_activation",
    3: "physique_energie",
    4: "physique_stress",
    5: "cognition_certitude",
    6: "cognition_complexite",
    7: "cognition_abstraction",
}
COMMUNICATION_POSITIONS = {21: "comm_clarte", 22: "comm_formalite"}
CLASS_POSITIONS = {"01": 61, "02": 62, "03": 63, "04": 64, "05": 65, "06": 66}
PLACE_KEYWORDS = {
    41: ["maison", "home", "appart", "domicile", "chez moi", "chambre", "cuisine", "salon", "appartement", "résidence"],
    42: ["bureau", "office", "travail", "boulot", "entreprise", "réunion", "workspace", "job", "company", "meeting room"],
    43: ["voiture", "auto", "bus", "métro", "train", "avion", "transport", "car", "subway", "plane", "commute", "trajet"],
    44: ["café", "restaurant", "magasin", "centre", "public", "ville", "shop", "store", "mall", "downtown", "city"],
    45: ["parc", "forêt", "montagne", "plage", "nature", "jardin", "extérieur", "park", "forest", "beach", "outdoor"],
    46: ["hôpital", "clinique", "médecin", "dentiste", "pharmacie", "soin", "hospital", "clinic", "doctor", "pharmacy"],
    47: ["seul", "alone", "solo", "solitaire"],
    48: ["famille", "ami", "proche", "ensemble", "family", "friend", "together"],
    49: ["collègue", "client", "professionnel", "colleague", "professional"],
    50: ["foule", "public", "événement", "crowd", "event", "gathering"],
}
THEME_KEYWORDS = {
    67: ["santé", "médecin", "maladie", "sport", "douleur", "fatigue", "sommeil", "gym", "exercice", "hôpital",
         "symptôme", "traitement", "health", "doctor"],
    68: ["argent", "facture", "salaire", "achat", "prix", "banque", "paiement", "budget", "économie", "finance",
         "money", "cost", "payment", "invoice"],
    69: ["code", "programmation", "sql", "python", "api", "bug", "logiciel", "ordi", "tech", "ia", "algorithm",
         "software", "database", "server"],
    70: ["famille", "enfant", "parent", "frère", "sœur", "conjoint", "mariage", "bébé", "fils", "fille", "family",
         "child", "wife", "husband"],
    71: ["manger", "repas", "cuisine", "restaurant", "recette", "nourriture", "dîner", "déjeuner", "food", "meal",
         "cook", "eat", "drink"],
    72: ["carrière", "promotion", "emploi", "cv", "entrevue", "patron", "collègue", "projet", "réunion", "deadline",
         "job", "work", "career", "meeting"],
    73: ["jeu", "musique", "film", "livre", "guitare", "art", "loisir", "détente", "vacances", "hobby", "game",
         "music", "movie", "book", "relax"],
    74: ["cours", "étude", "université", "examen", "prof", "étudiant", "recherche", "thèse", "diplôme", "school",
         "study", "university", "student", "exam"],
    75: ["voyage", "avion", "hôtel", "tourisme", "destination", "valise", "passeport", "travel", "trip", "flight",
         "vacation"],
    76: ["loi", "juridique", "avocat", "procès", "contrat", "droit", "légal", "law", "legal", "lawyer", "court",
         "contract"],
    77: ["environnement", "climat", "écologie", "pollution", "nature", "vert", "environment", "climate", "ecology",
         "green", "sustainable"],
    78: ["politique", "gouvernement", "élection", "parti", "vote", "ministre", "politics", "government", "election",
         "policy"],
}
THEME_TRIGGERS = {
    67: ["health", "santé", "medical", "medicine", "disease", "illness", "body", "corps", "pain", "douleur", "healing"],
    68: ["money", "argent", "wealth", "richesse", "payment", "paiement", "commerce", "trade", "property", "propriété",
         "finance"],
    69: ["computer", "ordinateur", "digital", "numérique", "software", "machine", "technology", "technologie", "code",
         "algorithm"],
    70: ["family", "famille", "kinship", "parenté", "marriage", "mariage", "child", "enfant", "parent", "domestic"],
    71: ["food", "nourriture", "eating", "manger", "drink", "boire", "nutrition", "meal", "repas", "taste", "goût"],
    72: ["work", "travail", "business", "affaires", "occupation", "métier", "profession", "career", "carrière", "job",
         "emploi"],
    73: ["play", "jeu", "leisure", "loisir", "amusement", "entertainment", "music", "musique", "art", "recreation",
         "sport"],
    74: ["education", "éducation", "learning", "apprentissage", "school", "école", "teaching", "enseignement", "study",
         "étude"],
    75: ["travel", "voyage", "journey", "trajet", "destination", "tourism", "tourisme", "foreign", "étranger"],
}
PLACE_NAMES = {41: "maison", 42: "travail", 43: "transport", 44: "public", 45: "nature", 46: "soin"}
CLASS_NAMES = {61: "Abstrait", 62: "Espace", 63: "Matière", 64: "Intellect", 65: "Volition", 66: "Affections"}
THEME_NAMES = {67: "Santé", 68: "Finance", 69: "Tech", 70: "Famille", 71: "Alim", 72: "Travail", 73: "Loisirs",
               74: "Éduc", 75: "Voyage"}

# --- hybrid search (fixed values) ----------------------------------------------------------------
DEFAULT_WEIGHTS = {"tags_roget": 0.30, "emotion": 0.30, "timestamp": 0.30, "personnes": 0.0, "resume_texte": 0.10}
PROFILE_WEIGHTS = {"tags_roget": 0.40, "emotion": 0.40, "timestamp": 0.20, "personnes": 0.0, "resume_texte": 0.0}
MASK_POSITIONS = {"emotion": [1, 2, 3, 4, 5, 6, 7], "tags_roget": [61, 62, 63, 64, 65, 66]}
OUTSIDE_VECTOR = ["timestamp", "personnes", "resume_texte"]

# --- link types and their weights (fixed values) -------------------------------------------------
LINK_WEIGHTS = {
    "LIEN_PERSONNE": 1.5,
    "LIEN_PROJET": 1.5,
    "RESONANCE_EMOTION": 1.2,
    "MEME_GROUPE": 1.8,
    "TAGS_PARTAGES": 1.3,
    "LIEN_VERSION": 2.0,
}

# --- query parsing (fixed values) ----------------------------------------------------------------
QUERY_STOPWORDS = [
    "dans", "avec", "pour", "cette", "quand", "comment", "pourquoi", "quel", "quelle", "quels", "quelles", "nous",
    "vous", "leur", "notre", "votre", "été", "être", "avoir", "fait", "faire", "plus", "moins", "très", "aussi",
    "donc", "souviens", "rappelle", "parlé", "discuté", "discussion", "conversation", "conversations", "est", "sont",
    "qui", "que", "quoi", "sur", "les", "des", "une",
    "the", "and", "that", "this", "with", "from", "what", "when", "where", "which", "about", "have", "been", "were",
    "will",
]
PERSON_STOPWORDS = ["qui", "que", "quoi", "comment", "pourquoi", "quand", "est", "sont", "etait", "était", "les", "des"]
# capitalised words that are tools, institutions or places; callers add their own project names
KNOWN_NAMES = [
    "python", "azure", "dropbox", "github", "google", "drive", "onedrive", "openai", "anthropic", "gemini", "claude",
    "chatgpt", "gpt", "flask", "fastapi", "sqlite", "pycharm", "pythonanywhere",
    "québec", "canada", "montréal", "paris", "france",
]
RELATIVE_DAYS = [(["hier", "yesterday"], 1), (["semaine", "week"], 7), (["mois", "month"], 30)]
CONTENT_TYPES = [
    (["question", "demande", "ask"], "question"),
    (["décision", "decision", "choisi", "chose"], "decision"),
    (["réflexion", "pensée", "thought"], "reflexion"),
]
DOMAINS = [
    (["travail", "work", "professionnel", "projet"], "professionnel"),
    (["personnel", "personal", "famille", "ami"], "personnel"),
    (["technique", "technical", "code", "python"], "technique"),
]
TARGET_EMOTIONS = [
    (["content", "happy", "joie", "positif"], (0.7, 0.5)),
    (["triste", "sad", "négatif", "frustré"], (-0.7, 0.5)),
    (["calme", "calm", "serein", "peaceful"], (0.3, 0.2)),
    (["excité", "excited", "énergique", "motivated"], (0.5, 0.9)),
]

# --- corpus stopwords (fixed values) -------------------------------------------------------------
FRENCH_STOPWORDS = """
le la les de du des un une et est en que qui dans pour sur avec ce se ne pas plus par son sa ses au aux ou mais donc
je tu il elle nous vous ils elles on ça ai as a avons avez ont suis es sommes êtes sont été être avoir fait faire dit
dire peut veux peux dois faut tout tous toute toutes même autre autres bien très peu encore déjà comme quand comment
où pourquoi parce car si oui non ok alors cela ceci ici là puis après avant entre sous chez vers
""".split()
ENGLISH_STOPWORDS = """
the a an is are was were be been being have has had do does did will would could should may might must shall can to of
in for on with at by from as into through it its this that these those i you he she we they me him her us them my your
his our their what which who whom when where why how all each every both few more most other some such no nor not only
own same so than too very just also now here there then if
""".split()
CONVERSATION_MARKERS = ["user", "assistant", "human", "claude", "chatgpt", "gpt"]
CORPUS_STOPWORDS = [*FRENCH_STOPWORDS, *ENGLISH_STOPWORDS, *CONVERSATION_MARKERS]

# --- correction sentences (fixed patterns) -------------------------------------------------------
CORRECTION_PATTERNS = [
    r"non[,\s]+c'est\s+(.+?)(?:\.|$)",
    r"en fait[,\s]+c'est\s+(.+?)(?:\.|$)",
    r"correction\s*:\s*(.+?)(?:\.|$)",
    r"la (?:vraie|bonne) (?:date|réponse|info)\s+(?:est|c'est)\s+(.+?)(?:\.|$)",
    r"(?:tu|vous)\s+(?:te|vous)\s+trompe[sz]?\s*[,:]?\s*(.+?)(?:\.|$)",
    r"c'est\s+(?:pas|plus)\s+(.+?)\s*[,;]\s*c'est\s+(.+?)(?:\.|$)",
    r"(?:ce n'est|c'est) pas\s+(.+?)\s*[,;]\s*(?:mais|c'est)\s+(.+?)(?:\.|$)",
    r"oublie\s+(.+?)\s*[,;]\s*(?:c'est|utilise)\s+(.+?)(?:\.|$)",
    r"ne\s+(?:dis|utilise)\s+plus\s+(.+?)(?:\.|$)",
]

# --- code languages, first hit wins (fixed values) -----------------------------------------------
CODE_HINTS = [
    ("python", "exact", ["import ", "from ", "def ", "class ", "print(", "if __name__"]),
    ("latex", "exact", ["\\frac", "\\begin{", "\\end{", "$$", "\\alpha", "\\beta", "\\sum"]),
    ("html", "lower", ["<html", "<div", "<span", "</div>", "<!doctype"]),
    ("sql", "upper", ["SELECT ", "FROM ", "WHERE ", "INSERT ", "UPDATE ", "CREATE TABLE"]),
    ("javascript", "exact", ["const ", "let ", "function ", "=>", "console.log"]),
    ("bash", "exact", ["echo ", "#!/bin/bash", "sudo ", "apt "]),
]

SIZE_UNITS = ["o", "Ko", "Mo", "Go", "To"]
# extensions the enrichment and research jobs read (fixed values)
TEXT_EXTENSIONS = [".txt", ".md", ".py", ".json", ".yaml", ".yml", ".csv", ".html", ".css", ".js", ".sql", ".sh", ".xml",
                   ".pdf", ".doc", ".docx", ".rtf"]
RESEARCH_EXTENSIONS = [".txt", ".md", ".markdown", ".pdf", ".docx", ".doc", ".rtf", ".html", ".htm", ".tex", ".json",
                       ".xml"]
REFLECTION_TYPES = ["intuition", "brouillon", "analyse", "etat_mental", "fil_ariane", "heuristique"]

# signs of code and of talk in a text (fixed values): the form looked at, and what it must hold; `trimmed`: first and last characters
CONTENT_SIGNS = {
    "code": [
        ("text", "```"), ("text", "import "), ("text", "function "), ("text", "def ", ":"), ("text", "class ", ":"), ("lower", "curl "),
        ("text", '"action":'), ("text", '"status":'), ("trimmed", "{", "}"), ("trimmed", "[", "]"),
    ],
    "talk": [("text", "?"), ("text", "!"), ("lower", "bonjour"), ("lower", "merci"), ("lower", "je "), ("lower", "tu "), ("lower", "nous ")],
}
