"""Fixed values that results must agree on, in one place."""

# Base detection.
RADIUS_SAFETY = 0.98
ALPHAS = (1.5, 1.7, 1.9, 2.1, 2.3)
BETAS = (2.0, 2.3, 2.6, 2.9)
FALLBACK = (1.9, 2.3)
NEIGHBOUR = 3  # the k of the k-th nearest neighbour
LEAST_COMPONENT = 4
CENTER_MERGE = 0.11  # radius as a share of the shorter side
GROWTH_STEPS = (64.0, 16.0, 4.0, 1.0, 0.25)
GROWTH_TURNS = 20_000
# Terrain, minitiles.
WALK, RAMP = 1, 2
MERGE_SIZE, MERGE_ALTITUDE, MERGE_RATIO = 80, 10.0, 0.90
SEED_RADIUS = 12
GEYSER_REACH = 400  # pixels
REACH_START, REACH_EXPANSION = 200.0, 52.0
CHOKE_WIDTH = 64
EXIT_CELLS = 4
SIDE_REACH = 24
DIRECTIONS = 36
CHOKE_APART = 8
SIDE_ROOM_OPENING, PLATEAU_SHARE, ROOM_SHARE = 1.5, 3, 2
GAP_FRONTIER, GAP_EXIT = 3, 2
CENTER_DIAMETER, CENTER_OVERLAP = 0.2, 0.25
OUTLINE_EPSILON = 0.9
# Names and images.
FUZZY = 0.82
PX_PER_TILE, PX_PER_MINITILE = 32, 8
SHADOW_OPACITY, RESOURCE_SHADOW_ALPHA = 0.47, 120
IMAGE_MAX_DIM = 2560
IOU_LEAST, DRIFT_MOST = 0.80, 16.0
# Slug of a tileset -> asset folder.
TILESET_FOLDERS = {
    "badlands": "badlands", "space-platform": "platform", "platform": "platform", "install": "install", "installation": "install",
    "ashworld": "ashworld", "jungle": "jungle", "desert": "desert", "arctic": "ice", "ice": "ice", "twilight": "twilight", "unknown": "badlands",
}
DIRECT_FOLDERS = ("badlands", "platform", "install", "ashworld", "jungle", "desert", "ice", "twilight")
# Resource sprites, in the order in which minerals cycle through them.
MINERAL_SPRITES = ("neutral/min01", "neutral/min02", "neutral/min03")
GEYSER_SPRITE = "neutral/geyser"
