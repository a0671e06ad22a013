"""Published observations and results the library must reproduce."""

# Seconds to stage 3 and stage 4 per animal; None = not reached.
MAIN_TIMES = {
    "2.5_5": {
        100: (42, 1217), 101: (244, 1490), 103: (219, 1890),
        104: (87, 1910), 105: (234, 1505), 112: (252, 602),
    },
    "3_20": {
        106: (None, None), 107: (None, None), 108: (1740, None),
        109: (None, None), 110: (1227, None), 111: (None, None),
    },
}
ONE_SECOND_TIMES = {
    "2_1": {
        1: (9, 92), 2: (24, 25), 3: (6, 10), 4: (2, 13), 5: (0, 8),
        6: (0, 5), 7: (0, 8), 8: (5, 13), 9: (5, 7), 10: (8, 26),
    },
    "2.5_1": {
        11: (11, 12), 12: (5, 28), 13: (10, 160), 14: (4, 16), 15: (16, 17),
        16: (6, 167), 17: (8, 83), 18: (7, 17), 19: (12, 139), 20: (18, 19),
    },
}
# Recording, trough time, marker time, cohort.
TROUGHS = [
    ("311024_01.csv", 515, 481, "2.5V"),
    ("311024_02.csv", 955, 941, "2.5V"),
    ("071124_05.csv", 988, 969, "2.5V"),
    ("240925_97.csv", 1228, 1190, "2.5V"),
    ("230925_94.csv", 1285, 1279, "2.5V"),
    ("240925_98.csv", 995, 977, "2.5V"),
    ("150125_17.csv", 997, 932, "0"),
    ("200225_19.csv", 880, 786, "0"),
    ("200225_23.csv", 939, 816, "0"),
    ("220225_28.csv", 808, 719, "0"),
    ("030225_30.csv", 672, 605, "-2.5"),
    ("030225_32.csv", 791, 623, "2.5_5"),
    ("030225_33_34.csv", 842, 805, "-2.5"),
    ("030225_35_36.csv", 776, 715, "-2.5"),
    ("130225_46a.csv", 1300, 1243, "0"),
    ("030225_31.csv", 739, 718, "-2.5"),
    ("130225_47v2.csv", 1031, 976, "2.5_5"),
    ("180225_50.csv", 1408, 1357, "-2.5"),
    ("180225_51.csv", 1344, 1174, "2.5_5"),
    ("240225_61.csv", 986, 832, "2.5_5"),
    ("180225_49.csv", 1753, 1559, "2.5_5"),
    ("150125_15.csv", 550, 530, "3V"),
    ("120624_613_v3.csv", 712, 703, "3V"),
    ("190624_616.csv", 800, 772, "3V"),
    ("180925_92.csv", 1099, 1067, "3V"),
]


def behaviour(times: dict) -> list[tuple]:
    """Rows of (animal, cohort, stage, seconds)."""
    return [
        (animal, cohort, f"stage_{stage}", float(t) if t is not None else None)
        for cohort, animals in times.items()
        for animal, both in animals.items()
        for stage, t in zip((3, 4), both)
    ]


BEHAVIOUR = "animal int, cohort string, stage string, seconds double"
