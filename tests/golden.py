"""Golden values: the reference's dictionary file (21 rows, file order) and the
both-way translations of the ten sample pairs worked out from the reference's rules."""

# Induced dictionary, (Tibetan syllable, English word) in first-seen order.
GOLDEN_DICTIONARY = [
    ("ཁྱེད", "what"), ("རང", "is"), ("ག", "you?"), ("ང", "i"), ("བདེ", "am"), ("པོ", "well."),
    ("ཐུགས", "thank"), ("རྗེ", "you."), ("དགོངས", "sorry/excuse"), ("དག", "me."),
    ("བཀྲ", "hello/greetings."), ("ཞོགས", "good"), ("པ", "morning."), ("མཚན", "good"), ("མོ", "night."),
    ("གི", "your"), ("མིང", "name"), ("ངའི", "my"), ("ལ", "is"), ("_ཟེར", "_."), ("དགའ", "welcome."),
]

# Fixed values: (line_no, translated to English, translated to Tibetan).
GOLDEN_BOTH_WAYS = [
    (0, "what is you? [འདྲས] [ཡོད]", "[how][are]ག"),
    (1, "i am well. [ཡིན]", "ངབདེཔོ"),
    (2, "thank you. [ཆེ]", "ཐུགསརྗེ"),
    (3, "sorry/excuse me.", "དགོངསདག"),
    (4, "hello/greetings. [ཤིས] am [ལེགས]", "བཀྲ"),
    (5, "good morning. am [ལེགས]", "མཚནཔ"),
    (6, "good night. am [ལེགས]", "མཚནམོ"),
    (7, "what is your name is you? [རེ] [ཞུ] your [ཡོད]", "ཁྱེདལགི[name?]"),
    (8, "my name is _. [གྱི] [ཡོད]", "ངའིམིངལ_ཟེར"),
    (9, "welcome. [བསུ] [ཞུ]", "དགའ"),
]
