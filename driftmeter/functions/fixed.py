"""Tables, thresholds and labels that results must agree on.

Every number and word below is part of the definition of a metric or of an
exchange format.  Nothing here is tuned; operators take these as defaults.
"""

from __future__ import annotations

# --- fixed values: directory names that never take part in a scan (case is ignored)
IGNORED_DIRECTORIES = (
    ".git", ".hg", ".svn",
    "node_modules", "vendor", "packages", ".nuget", "Pods",
    "bin", "obj", "out", "dist", "build", "target",
    "__pycache__", ".gradle", ".m2",
    ".vs", ".idea", ".vscode",
    "coverage", ".nyc_output",
    ".next", "DerivedData", ".dart_tool", ".pub-cache",
)

# --- fixed values: language by file extension (case is ignored)
LANGUAGE_EXTENSIONS = {
    "Java": (".java",),
    "CSharp": (".cs",),
    "C": (".c", ".h"),
    "Cpp": (".cpp", ".cc", ".cxx", ".hpp"),
    "TypeScript": (".ts", ".tsx"),
    "JavaScript": (".js", ".jsx", ".mjs", ".cjs"),
    "Rust": (".rs",),
    "Python": (".py",),
}
C_STYLE_LANGUAGES = ("C", "Cpp", "Java", "CSharp", "TypeScript", "JavaScript", "Rust")

PRODUCTION, UTILITY = "Production", "Utility"

# --- fixed values: smell bands of a function's cyclomatic complexity (low, high]
SMELL_HIGH_ABOVE, SMELL_MEDIUM_ABOVE, SMELL_LOW_ABOVE = 20, 15, 10
SMELL_WEIGHTS = {"smells_high": 3.0, "smells_medium": 2.0, "smells_low": 1.0}

# --- fixed values: a file takes part in the entropy only above this badness
EPSILON = 1e-9

# --- fixed values: severity scales, strict lower bounds from worst to mildest
SEVERITY_SCALES = {
    "sloc": ((500, "Very Large"), (200, "Large"), (100, "Medium"), (None, "Small")),
    "cc": ((20, "High Risk"), (10, "Moderate"), (5, "Low"), (None, "Good")),
    "smells": ((15, "Critical"), (7, "Warning"), (2, "Minor"), (None, "Clean")),
    "coupling": ((20, "Very High"), (10, "High"), (5, "Moderate"), (None, "Low")),
    "badness": ((3.0, "Critical"), (2.0, "High"), (1.0, "Moderate"), (None, "Low")),
    "diffusion": ((0.3, "Dominant spreader"), (0.15, "High spread"), (0.05, "Moderate"), (None, "Low")),
    "delta": ((1.0, "Large regression"), (0.5, "Regression"), (0.1, "Minor regression"), (None, "Minimal")),
}

# --- fixed values: ten-step size gradients, exclusive upper bounds of steps 0..8
SIZE_GRADIENTS = {
    "sloc": (50, 100, 150, 200, 300, 400, 500, 750, 1000),
    "cc": (5, 10, 15, 20, 25, 30, 40, 50, 75),
    "smells": (2, 5, 8, 12, 16, 20, 25, 30, 40),
}

# --- fixed values: drift grades, exclusive upper bounds of the entropy score
DRIFT_GRADES = ((0.3, "Excellent"), (0.7, "Good"), (1.2, "Fair"), (2.0, "Poor"), (None, "Critical"))
BADGE_BANDS = ((0.5, "green"), (1.5, "yellow"), (None, "red"))
GAUGE_BANDS = ((33.0, "green"), (66.0, "yellow"), (None, "red"))
GAUGE_FULL_SCALE = {"entropy": 3.0, "cc": 20.0, "smells": 15.0}

# --- fixed values: position of a score within its own history, inclusive upper bounds in percent
POSITION_LABELS = (
    (25.0, "near its historical low"),
    (50.0, "below its historical average"),
    (75.0, "above its historical average"),
    (90.0, "near its historical high"),
    (None, "at or near its all-time high"),
)

# --- fixed values: history classification and forecast thresholds
OUTLIER_SIGMAS = 1.5
MIN_NOTABLE_DELTA = 0.02
ELEVATION = 0.05
HEAT_WINDOW = 3
COLD_SHARE = 0.7
TREND_DEAD_ZONE = 0.001
WARMING_DELTA = 0.01

# --- fixed values: list lengths and point budgets
TOP_FILES = 10
TOP_EVENTS = 5
HEAT_BAR_STEPS = 10
STATS_POINTS, CHART_POINTS, COMPARE_POINTS = 200, 500, 300
