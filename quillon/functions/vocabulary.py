"""Fixed values of the engine: settings, vocabularies, unit tables."""

from __future__ import annotations

# Thresholds and multipliers of matching and scoring.
FUZZY_THRESHOLD = 0.6
CORE_SCORE = 2.0
NAME_EXACT, NAME_FUZZY = 2.0, 1.6
ALIAS_PENALTY = 0.9
GOAL_FACTOR = 4.0
CO_MATCH_BASE, CO_MATCH_CAP = 1.2, 2.0
UNMATCHABLE_SHARE = 0.003
ONE_MATCH_SHARES = (0.0003, 0.0007)
DIMINISHING = (1.0, 0.5, 0.1, 0.0)
DIMINISHING_VALUES = (1.0, 0.2, 0.0)
NUMBER_TOLERANCE, NUMBER_NEAR_SCORE = 0.3, 0.7
MEASUREMENT_RANGE = (0.5, 1.5)
MEASUREMENT_MISS = 0.5
VALUE_MISS = 0.2
VERB_SCORES = (1.0, 0.9)
VERB_CAPS = {"verb_target": 4, "verb_context": 2, "verb": 2}
TERM_CAP = 6
#: (exact, same type) -> multiplier
TOKEN_MULTIPLIERS = {(True, True): 0.3, (True, False): 0.2, (False, True): 0.2, (False, False): 0.1}
COMPONENT_MULTIPLIERS = {(True, True): 0.5, (True, False): 0.4, (False, True): 0.4, (False, False): 0.3}

# Factors to the base unit of each quantity (cm, g, cm^3, degree C, s, degree); None: not a factor.
UNITS: dict[str, dict[str, float | None]] = {
    "length": {"mm": 0.1, "millimeter": 0.1, "millimeters": 0.1, "cm": 1.0, "centimeter": 1.0, "centimeters": 1.0, "m": 100.0, "meter": 100.0, "meters": 100.0, "km": 100000.0},
    "mass": {"mg": 0.001, "milligram": 0.001, "milligrams": 0.001, "g": 1.0, "gram": 1.0, "grams": 1.0, "kg": 1000.0, "kilogram": 1000.0, "kilograms": 1000.0},
    "volume": {"mm^3": 0.001, "mm3": 0.001, "cm^3": 1.0, "cm3": 1.0, "cc": 1.0, "ml": 1.0, "milliliter": 1.0, "milliliters": 1.0, "l": 1000.0, "liter": 1000.0, "liters": 1000.0, "m^3": 1000000.0, "m3": 1000000.0},
    "temperature": {"c": 1.0, "celsius": 1.0, "f": None, "k": None},
    "time": {"s": 1.0, "sec": 1.0, "second": 1.0, "seconds": 1.0, "min": 60.0, "minute": 60.0, "minutes": 60.0, "hr": 3600.0, "hour": 3600.0, "hours": 3600.0},
    "angle": {"degree": 1.0, "degrees": 1.0, "radian": 57.2958, "radians": 57.2958},
}

# Words that are never tokens.
STOP_WORDS = frozenset(
    """true false on off none open closed current value to from in the a an low medium high yes no 0 1 and or
    with for of at by is are was were be been being have has had do does did will would shall should may might
    must can could this that these those i you he she it we they me him her us them my your his its our their
    mine yours hers ours theirs category action template object trajectory function precondition state_change
    goal_state dimension dimensions position relation relative_to unit memory objects actions templates aliases
    categories functions materials relationr content contents state surface""".split()
)
UNIT_WORDS = frozenset(unit for table in UNITS.values() for unit in table) | {"percent", "%"}

# Attribute components that are structure, not content.
STRUCTURAL_COMPONENTS = frozenset(
    """length width height_thickness height mass weight shape dimensions volume duration repetitions cycle_duration
    start_offset temporal_type number position position_relative_body material materials category categories
    function functions relation relative_to relationr content contents state participants participant color
    surface""".split()
)

# Restricted spatial relations, and categories that say too little.
SPATIAL_RELATIONS = ("on", "in", "below", "above", "around", "through", "contact", "attached", "between", "near", "apart")
GENERIC_CATEGORIES = ("object", "physical_object", "person", "agent", "entity", "human", "living_thing")

# Prefixes of index terms, by what they match.
TOKEN_TYPES = {"attribute_token": "attribute", "value_token": "value", "object_token": "object", "action_token": "action"}
CONDITIONAL = "statechangesC_"
#: Separators that end a word.
SEPARATORS = "_:=->./\\()[]{} '\""
