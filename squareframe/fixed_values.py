"""Fixed values. They must equal the published feature definitions for results to agree; change them only as parameters."""

# material values per piece kind: pawn, knight, bishop, rook, queen, king
MATERIAL = {"p": 1, "n": 3, "b": 3, "r": 5, "q": 9, "k": 0}

# king safety: weights per unit and bonus for a king on a wing
KING_SAFETY = {"pawn_shield": 2, "king_attackers": -3, "king_open_files": -2, "castling_bonus": 4}

# tactical totals
TACTICS = {"pins": 1, "forks": 2, "discovered_attacks": 3}

EMPTY_BOARD = "8/8/8/8/8/8/8/8 w - - 0 1"
RATING_BOUNDS = (500, 3500)
MAX_MISSING_SHARE = 0.2
HIGH_CONFIDENCE = 0.7

FIRST_MOVES = ["e4", "d4", "c4", "Nf3", "g3", "f4", "b3", "Nc3"]
REPLIES_E4 = ["e5", "c5", "e6", "c6", "d6", "d5", "g6", "Nf6"]
REPLIES_D4 = ["d5", "Nf6", "f5", "e6", "c5", "g6", "d6", "c6"]

# named opening sequences
OPENING_SEQUENCES = {
    "ruy_lopez": "e4 e5 Nf3 Nc6 Bb5",
    "italian_game": "e4 e5 Nf3 Nc6 Bc4",
    "sicilian_defense": "e4 c5",
    "french_defense": "e4 e6",
    "caro_kann": "e4 c6",
    "queens_gambit": "d4 d5 c4",
    "kings_indian": "d4 Nf6 c4 g6",
    "english_opening": "c4",
    "queens_pawn": "d4 d5",
    "dutch_defense": "d4 f5",
    "pirc_defense": "e4 d6",
    "scandinavian": "e4 d5",
}

# ECO letter, name, moves; in priority order within a letter
ECO_PATTERNS = [
    ("A", "English", "c4"),
    ("A", "Reti", "Nf3 d5 c4"),
    ("A", "Kings_Fianchetto", "g3"),
    ("A", "Sokolsky", "Nf3 Nf6 c4 g6 b4"),
    ("A", "Birds", "f4"),
    ("B", "Sicilian", "e4 c5"),
    ("B", "Caro_Kann", "e4 c6"),
    ("B", "Pirc_Modern", "e4 d6"),
    ("B", "Alekhine", "e4 Nf6"),
    ("B", "Scandinavian", "e4 d5"),
    ("C", "Open_Game", "e4 e5"),
    ("C", "Italian", "e4 e5 Nf3 Nc6 Bc4"),
    ("C", "Ruy_Lopez", "e4 e5 Nf3 Nc6 Bb5"),
    ("C", "French", "e4 e6"),
    ("C", "Kings_Gambit", "e4 e5 f4"),
    ("D", "Queens_Gambit", "d4 d5 c4"),
    ("D", "Slav", "d4 d5 c4 c6"),
    ("D", "Grunfeld", "d4 Nf6 c4 g6 Nc3 d5"),
    ("D", "Semi_Slav", "d4 d5 c4 e6 Nc3 c6"),
    ("E", "Nimzo_Queens_Indian", "d4 Nf6 c4 e6"),
    ("E", "Kings_Indian", "d4 Nf6 c4 g6"),
    ("E", "Catalan", "d4 Nf6 c4 e6 g3"),
    ("E", "Benoni", "d4 Nf6 c4 c5"),
]

# opening line, family, ECO letter; the longest line that starts the move list wins
LINE_FAMILIES = [
    ("e4 e5", "Kings_Pawn", "C"),
    ("e4 c5", "Sicilian_Defense", "B"),
    ("e4 e6", "French_Defense", "C"),
    ("e4 c6", "Caro-Kann_Defense", "B"),
    ("d4 d5", "Queens_Pawn", "D"),
    ("d4 Nf6", "Indian_Defense", "E"),
    ("c4 e5", "English_Opening", "A"),
    ("Nf3 d5", "Reti_Opening", "A"),
    ("e4 e5 Nf3", "Kings_Pawn", "C"),
    ("e4 e5 Nf3 Nc6", "Open_Game", "C"),
    ("e4 e5 Nf3 Nc6 Bc4", "Italian_Game", "C"),
    ("e4 e5 Nf3 Nc6 Bb5", "Ruy_Lopez", "C"),
    ("d4 d5 c4", "Queens_Gambit", "D"),
    ("d4 d5 c4 e6", "Queens_Gambit_Declined", "D"),
    ("d4 d5 c4 c6", "Slav_Defense", "D"),
    ("d4 Nf6 c4 g6", "Kings_Indian_Defense", "E"),
    ("d4 Nf6 c4 e6", "Queens_Indian_Defense", "E"),
    ("e4 c5 Nf3", "Sicilian_Defense", "B"),
    ("e4 c5 Nf3 d6", "Sicilian_Defense", "B"),
    ("e4 c5 Nf3 Nc6", "Sicilian_Defense", "B"),
]

# words that stay together with the word after them when a tag is split
PREFIX_WORDS = ["King", "Kings", "Queen", "Queens", "Ruy", "Semi", "Neo", "Nimzo", "Bogo"]
TYPE_WORDS = ["defense", "attack", "variation", "gambit", "system", "opening"]

# name groups: a group flag is set when a family or variation name holds one of its terms
ECO_NAME_TERMS = {
    "A": ["english", "reti", "bird", "larsen", "dutch", "benoni", "zukertort", "sokolsky"],
    "B": ["sicilian", "caro-kann", "pirc", "modern", "alekhine", "scandinavian"],
    "C": ["ruy_lopez", "italian", "french", "petrov", "petroff", "kings_gambit", "vienna", "scotch"],
    "D": ["queens_gambit", "slav", "grunfeld", "tarrasch", "semi-slav"],
    "E": ["indian", "nimzo", "queens_indian", "kings_indian", "catalan", "bogo"],
}
STYLE_TERMS = {
    "aggressive": ["sicilian", "kings_gambit", "dragon", "najdorf", "alekhine", "benoni", "smith-morra"],
    "positional": ["caro-kann", "queens_gambit", "french", "ruy_lopez", "slav", "london", "catalan"],
    "hypermodern": ["reti", "alekhine", "modern", "pirc", "kings_indian", "catalan", "larsen"],
    "classical": ["ruy_lopez", "italian", "vienna", "scotch", "queens_gambit", "giuoco_piano"],
    "solid": ["caro-kann", "french", "slav", "berlin", "petroff", "petrovs", "queens_gambit_declined"],
    "theoretical": ["sicilian_najdorf", "sicilian_dragon", "ruy_lopez_marshall", "kings_indian", "grunfeld"],
}
FIRST_PAIR_TERMS = {
    "e4_e5": ["kings_pawn", "kings_gambit", "vienna", "italian", "ruy_lopez", "scotch", "petrov", "petroff"],
    "e4_c5": ["sicilian"],
    "e4_e6": ["french"],
    "e4_c6": ["caro-kann"],
    "e4_d6": ["pirc", "modern", "philidor"],
    "e4_nf6": ["alekhine", "petrov", "petroff"],
    "d4_d5": ["queens_gambit", "slav", "semi-slav", "tarrasch"],
    "d4_nf6": ["indian", "nimzo", "kings_indian", "grunfeld", "benoni", "budapest"],
    "c4_e5": ["english_reversed_sicilian"],
    "c4_c5": ["english_symmetrical"],
    "nf3_d5": ["reti", "zukertort"],
    "nf3_nf6": ["reti_symmetrical"],
}
STRUCTURE_TERMS = {
    "central_pawns": ["queens_gambit", "kings_pawn", "italian", "spanish", "vienna"],
    "fianchetto": ["kings_indian", "catalan", "modern", "pirc", "reti", "sicilian_dragon"],
    "isolated_queens_pawn": ["tarrasch", "queens_gambit_accepted"],
    "hanging_pawns": ["tarrasch", "queens_gambit_declined"],
    "pawn_chain": ["french", "kings_indian"],
}

# exact theme words behind the category flags ("mate" is matched as a substring instead)
THEME_FLAGS = {
    "is_fork": "fork",
    "is_pin": "pin",
    "is_skewer": "skewer",
    "is_discovery": "discoveredattack",
    "is_sacrifice": "sacrifice",
    "is_promotion": "promotion",
    "is_endgame": "endgame",
    "is_middlegame": "middlegame",
    "is_opening": "opening",
}

# rating ranges: evaluation buckets, range models, loss weights, labels
EVALUATION_BOUNDS = [0, 1000, 1500, 2000, 2500, 3000]
MODEL_RANGES = [(0, 1000), (1000, 1500), (1500, 2000), (2000, 2500), (2500, 3000), (3000, 3500)]
RANGE_OVERLAP = 100
LOSS_RANGES = [(0, 1200, 1.0), (1200, 1800, 1.5), (1800, 2400, 1.2), (2400, 3500, 1.0)]
LABEL_RANGES = [
    (0, 1200, "Beginner"),
    (1201, 1600, "Intermediate"),
    (1601, 2000, "Advanced"),
    (2001, 2400, "Expert"),
    (2401, 3000, "Master"),
]
