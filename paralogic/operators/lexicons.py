"""Fixed values of the rewrite rules."""

# Frame -> (inverse frame, first role, second role)
INVERSE_FRAMES = {
    "buy-01": ("sell-01", ":ARG0", ":ARG2"),
    "sell-01": ("buy-01", ":ARG0", ":ARG2"),
    "rent-01": ("rent-02", ":ARG0", ":ARG2"),
    "lease-01": ("lease-02", ":ARG0", ":ARG2"),
    "parent-01": ("child-01", ":ARG0", ":ARG1"),
    "child-01": ("parent-01", ":ARG0", ":ARG1"),
    "mother-01": ("son-01", ":ARG0", ":ARG1"),
    "father-01": ("son-01", ":ARG0", ":ARG1"),
    "own-01": ("belong-01", ":ARG0", ":ARG1"),
    "belong-01": ("own-01", ":ARG0", ":ARG1"),
    "possess-01": ("belong-01", ":ARG0", ":ARG1"),
    "give-01": ("receive-01", ":ARG0", ":ARG2"),
    "receive-01": ("give-01", ":ARG0", ":ARG2"),
    "send-01": ("receive-01", ":ARG0", ":ARG2"),
    "deliver-01": ("receive-01", ":ARG0", ":ARG2"),
    "lend-01": ("borrow-01", ":ARG0", ":ARG2"),
    "borrow-01": ("lend-01", ":ARG0", ":ARG2"),
    "teach-01": ("learn-01", ":ARG0", ":ARG2"),
    "learn-01": ("teach-01", ":ARG0", ":ARG2"),
    "instruct-01": ("learn-01", ":ARG0", ":ARG2"),
    "discover-01": ("discover-01", ":ARG0", ":ARG1"),
    "invent-01": ("invent-01", ":ARG0", ":ARG1"),
    "create-01": ("create-01", ":ARG0", ":ARG1"),
    "write-01": ("write-01", ":ARG0", ":ARG1"),
    "build-01": ("build-01", ":ARG0", ":ARG1"),
    "lead-01": ("follow-01", ":ARG0", ":ARG1"),
    "follow-01": ("lead-01", ":ARG0", ":ARG1"),
    "precede-01": ("follow-01", ":ARG0", ":ARG1"),
    "succeed-01": ("precede-01", ":ARG0", ":ARG1"),
    "praise-01": ("appreciate-01", ":ARG0", ":ARG1"),
    "appreciate-01": ("praise-01", ":ARG0", ":ARG1"),
    "criticize-01": ("criticize-01", ":ARG0", ":ARG1"),
    "attack-01": ("defend-01", ":ARG0", ":ARG1"),
    "defend-01": ("attack-01", ":ARG0", ":ARG1"),
    "love-01": ("love-01", ":ARG0", ":ARG1"),
    "hate-01": ("hate-01", ":ARG0", ":ARG1"),
    "like-01": ("like-01", ":ARG0", ":ARG1"),
    "trust-01": ("trust-01", ":ARG0", ":ARG1"),
    "know-01": ("know-01", ":ARG0", ":ARG1"),
    "remember-01": ("remember-01", ":ARG0", ":ARG1"),
    "award-01": ("award-01", ":ARG1", ":ARG2"),
    "employ-01": ("work-09", ":ARG0", ":ARG1"),
    "hire-01": ("work-09", ":ARG0", ":ARG1"),
    "visit-01": ("visit-01", ":ARG0", ":ARG1"),
    "see-01": ("see-01", ":ARG0", ":ARG1"),
}

# Name of a role -> name of the inverse role ("manager" has its last value, "team")
INVERSE_ROLES = {
    "mother": "son", "father": "son", "parent": "child", "son": "parent", "daughter": "parent", "child": "parent",
    "husband": "wife", "wife": "husband", "sibling": "sibling", "brother": "sibling", "sister": "sibling",
    "grandfather": "grandson", "grandmother": "grandson", "grandson": "grandparent", "granddaughter": "grandparent",
    "uncle": "nephew", "aunt": "nephew", "nephew": "uncle", "niece": "uncle", "cousin": "cousin", "friend": "friend",
    "neighbor": "neighbor", "mentor": "mentee", "mentee": "mentor", "boss": "employee", "employee": "boss",
    "teacher": "student", "student": "teacher", "doctor": "patient", "patient": "doctor", "boyfriend": "girlfriend",
    "girlfriend": "boyfriend", "client": "provider", "customer": "provider", "capital": "country", "president": "country",
    "ceo": "company", "manager": "team",
}

# Frames of symmetric and of asymmetric relations
SYMMETRIC = ("marry-01", "sibling-01", "equal-01", "intersect-01", "border-01", "neighbor-01", "overlap-01", "coincide-01", "befriend-01", "agree-01")
ASYMMETRIC = (
    "exceed-01", "outrank-01", "outperform-01", "surpass-01", "lead-01", "manage-01", "supervise-01", "report-01", "parent-01", "child-01",
    "mother-01", "father-01", "own-01", "author-01", "create-01", "cause-01", "result-01", "have-degree-91",
)

# Role pairs of a binary relation, in order of preference
ARGUMENT_PAIRS = ((":ARG0", ":ARG1"), (":ARG1", ":ARG2"), (":ARG1", ":ARG4"), (":ARG0", ":ARG2"))

# Stem -> hypernym
HYPERNYMS = {
    "bark": "make-sound", "meow": "make-sound", "shout": "speak", "whisper": "speak", "robin": "bird", "sparrow": "bird", "dog": "animal",
    "cat": "animal", "rose": "flower", "tulip": "flower", "run": "move", "walk": "move", "sprint": "run",
}

# Modal frame -> dual frame
MODAL_DUALS = {
    "obligate-01": "possible-01", "require-01": "possible-01", "need-01": "possible-01", "must-01": "possible-01", "possible-01": "obligate-01",
    "permit-01": "prohibit-01", "allow-01": "prohibit-01", "prohibit-01": "permit-01", "forbid-01": "permit-01", "recommend-01": "recommend-01",
    "suggest-01": "suggest-01", "mandate-01": "possible-01", "mandatory-01": "possible-01",
}

# Aspect -> marker, and a wrong marker
ASPECT_MARKS = {"performance": "complete", "activity": "ongoing", "habitual": "habitual"}
WRONG_ASPECT_MARKS = {"performance": "ongoing", "activity": "complete", "habitual": "one-time"}
