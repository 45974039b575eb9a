"""Rule tables of the text operators.

All of these are fixed values: vocabularies, ordered pattern lists, phrases and limits
that decide the result.  Order matters wherever a list of pairs is used.
"""

# --- category resolution -------------------------------------------------------------
DATASET_CATEGORY = "All Beauty"
GENERIC_CATEGORY = "Beauty"
CATEGORY_DETAIL_KEYS = ["category", "main_category", "product_category", "category_name"]
CATEGORY_KEYWORDS = [
    ("hair", "Hair Care"), ("skin", "Skin Care"), ("makeup", "Makeup"), ("fragrance", "Fragrance"),
    ("nail", "Nail Care"), ("bath", "Bath & Body"), ("oral", "Oral Care"), ("shave", "Shaving"),
    ("wig", "Hair Care"), ("cleansing", "Skin Care"), ("moisturizer", "Skin Care"),
    ("serum", "Skin Care"), ("lip", "Makeup"), ("eye", "Makeup"), ("foundation", "Makeup"),
    ("perfume", "Fragrance"), ("cologne", "Fragrance"),
]
CATEGORY_KEYWORDS_WIDE = CATEGORY_KEYWORDS + [
    ("shampoo", "Hair Care"), ("conditioner", "Hair Care"), ("lotion", "Skin Care"),
    ("cream", "Skin Care"), ("toner", "Skin Care"), ("mask", "Skin Care"), ("brush", "Makeup"),
    ("mascara", "Makeup"), ("eyeliner", "Makeup"), ("blush", "Makeup"), ("concealer", "Makeup"),
]

# --- title cleaning ------------------------------------------------------------------
MEASUREMENT_TOKENS = [
    "inch", "inches", "in", "oz", "ounce", "ounces", "ml", "milliliter", "milliliters",
    "l", "liter", "liters", "g", "gram", "grams", "kg", "kilogram", "kilograms",
    "lb", "pound", "pounds", "cm", "centimeter", "centimeters", "m", "meter", "meters",
    "mm", "millimeter", "millimeters", "%", "percent", "pack", "packs", "count",
    "pcs", "pieces", "piece", "unit", "units", "size", "sizes", "dimension", "dimensions",
]
MARKETING_TOKENS = [
    "new", "best", "gift", "perfect", "trendy", "hot", "popular", "bestseller",
    "bestselling", "top", "premium", "luxury", "exclusive", "limited", "special",
    "amazing", "wonderful", "great", "excellent", "super", "ultra", "pro",
    "professional", "advanced", "improved", "enhanced", "upgraded",
]
DEMOGRAPHIC_TOKENS = [
    "for women", "for men", "for girls", "for boys", "for kids", "for children",
    "women", "men", "girls", "boys", "unisex", "adult", "adults",
]
MAX_TITLE_TOKENS = 35

# --- eligibility ---------------------------------------------------------------------
EMBED_KEYWORDS = [
    # eyes
    "eyelash", "eyelashes", "lash", "lashes", "false eyelash", "false eyelashes",
    "eyeliner", "mascara", "eyebrow", "brow", "eyebrows", "brows",
    "eyeshadow", "eye shadow", "eye makeup", "eye liner", "shadow", "shadow paint",
    # lips
    "lipstick", "lip stick", "lip gloss", "lipgloss", "lip balm", "lipbalm", "lip tint", "liptint",
    # face
    "foundation", "concealer", "blush", "bronzer", "highlighter",
    "makeup", "make up", "makeup kit", "makeup bag", "face paint", "facepaint", "paint",
    # skin
    "cream", "gel", "serum", "lotion", "moisturizer", "moisturiser",
    "cleanser", "toner", "mask", "face mask", "skincare", "skin care",
    "sunscreen", "sun screen", "sunscreen lotion",
    # hair
    "wig", "wigs", "hair extension", "hair extensions", "extension",
    "extensions", "scrunchie", "scrunchies", "headband", "hairband",
    "barrette", "hair clip", "hair clips", "hair brush", "hairbrush",
    "hair comb", "hairspray", "hair spray", "hair gel", "hair mousse",
    "hair weave", "weave", "lace front", "lacefront", "hair tie",
    "hair ties", "ponytail holder", "ponytail holders", "ponytail",
    # nails
    "nail", "nails", "nail polish", "nailpolish", "gel nail", "gelnail",
    "acrylic nail", "acrylicnail", "fake nail", "fakenail",
    "press on nail", "presson nail", "manicure", "pedicure",
    # tools
    "brush", "brushes", "comb", "combs", "applicator", "applicators",
    "makeup sponge", "makeupsponge", "beauty blender", "beautyblender",
    "tweezer", "tweezers", "eyelash glue", "eyelashglue",
    # body
    "temporary tattoo", "temporarytattoo", "body paint", "bodypaint",
    "body makeup", "bodymakeup", "tattoo", "tattoos", "face tattoo", "arm tattoo", "body tattoo",
    # fragrance
    "perfume", "cologne", "fragrance", "body spray", "bodyspray",
    # personal care
    "deodorant", "antiperspirant", "anti-perspirant", "shampoo",
    "conditioner", "soap", "body wash", "bodywash",
    # fashion
    "hat", "cap", "gloves", "sunglasses",
]
NEGATIVE_KEYWORDS = [
    "mask", "face mask", "gaiter", "bandana", "scarf", "breathing cover", "face covering",
    "face cover", "surgical mask", "n95", "respirator",
]
FACE_CONTEXT_KEYWORDS = [
    "makeup", "make up", "paint", "foundation", "concealer", "wash", "cleanser", "serum", "cream",
    "lotion", "moisturizer", "moisturiser", "toner", "mask", "scrub", "exfoliant", "exfoliating",
    "sunscreen", "sun screen",
]
SPECIFIC_HAIR_OBJECTS = [
    "wig", "wigs", "extension", "extensions", "clip", "clips", "brush",
    "comb", "scrunchie", "scrunchies", "headband", "hairband",
    "barrette", "hairspray", "hair spray", "gel", "mousse", "weave",
    "lace front", "lacefront", "hair tie", "hair ties",
    "ponytail holder", "ponytail holders", "ponytail",
]
SPECIFIC_MAKEUP_OBJECTS = [
    "eyeliner", "mascara", "eyeshadow", "lipstick", "foundation",
    "concealer", "blush", "bronzer", "highlighter", "eye makeup",
    "face makeup", "body makeup", "makeup kit", "shadow paint", "face paint", "paint",
]
GENERIC_WORDS = ["beauty", "cosmetic", "product", "accessory", "item"]
MIN_TITLE_TOKENS = 3

# --- product types -------------------------------------------------------------------
PRODUCT_TYPES = [
    ("beard straightener", "beard straightener"), ("hair straightener", "hair straightener"),
    ("heated hair brush", "heated hair brush"), ("hair dryer", "hair dryer"),
    ("hair curler", "hair curler"),
    ("lace front wig", "lace front wig"), ("lace front wigs", "lace front wig"),
    ("lace wig", "lace front wig"), ("13x1 lace front", "lace front wig"),
    ("13x1 lace", "lace front wig"), ("deep wave", "deep wave hair extension"),
    ("brazilian curly", "brazilian curly hair extension"), ("tape-in", "tape-in hair extension"),
    ("clip-in", "clip-in hair extension"), ("hair weave", "hair weave"),
    ("hair extension", "hair extension"), ("wig", "wig"), ("wigs", "wig"),
    ("scrunchie", "scrunchie"), ("headband", "headband"), ("hair clip", "hair clip"),
    ("hair clips", "hair clip"), ("hair claw", "hair claw clip"), ("hair barrette", "hair barrette"),
    ("hair accessory", "hair accessory"), ("hair accessories", "hair accessory"),
    ("hairspray", "hairspray"), ("hair spray", "hairspray"), ("hair gel", "hair gel"),
    ("styling gel", "hair gel"), ("hair mousse", "hair mousse"),
    ("hair styling", "hair styling product"),
    ("foundation", "foundation"), ("concealer", "concealer"),
    ("lipstick", "lipstick"), ("lip stick", "lipstick"), ("lip gloss", "lip gloss"),
    ("lip balm", "lip balm"),
    ("automatic eyeliner", "automatic eyeliner"), ("auto eyeliner", "automatic eyeliner"),
    ("eyeliner pencil", "eyeliner pencil"), ("eyeliner", "eyeliner"), ("mascara", "mascara"),
    ("eyeshadow", "eyeshadow"), ("eye shadow", "eyeshadow"), ("eyebrow pencil", "eyebrow pencil"),
    ("eyebrow", "eyebrow product"),
    ("face paint", "face paint"),
    ("blush", "blush"), ("bronzer", "bronzer"), ("face powder", "face powder"),
    ("makeup kit", "makeup kit"), ("cosmetic kit", "cosmetic kit"), ("beauty kit", "beauty kit"),
    ("makeup set", "makeup kit"),
    ("makeup brush", "makeup brush"), ("makeup brushes", "makeup brush set"),
    ("makeup sponge", "makeup sponge"), ("beauty sponge", "makeup sponge"),
    ("makeup tool", "makeup tool"),
    ("gel nail", "gel nail"), ("acrylic nail", "acrylic nail"), ("fake nail", "fake nail"),
    ("nail polish", "nail polish"), ("nail varnish", "nail polish"), ("nail lacquer", "nail polish"),
    ("cream", "cream"), ("gel", "gel"), ("serum", "serum"), ("face serum", "face serum"),
    ("lotion", "lotion"),
    ("cleanser", "cleanser"), ("face cleanser", "face cleanser"), ("toner", "toner"),
    ("mask", "mask"), ("face mask", "face mask"), ("hair mask", "hair mask"),
    ("moisturizer", "moisturizer"), ("moisturiser", "moisturizer"),
    ("shampoo", "shampoo"), ("conditioner", "conditioner"), ("hair treatment", "hair treatment"),
    ("perfume", "perfume"), ("cologne", "cologne"), ("fragrance", "fragrance"),
    ("deodorant", "deodorant"), ("deodarant", "deodorant"), ("antiperspirant", "antiperspirant"),
    ("anti-perspirant", "antiperspirant"),
    ("knitted hat", "knitted hat"), ("knitted cap", "knitted cap"),
    ("rabbit fur hat", "rabbit fur hat"), ("fur hat", "fur hat"), ("hat", "hat"), ("cap", "cap"),
    ("scarf", "scarf"), ("fashion accessory", "fashion accessory"),
    ("tweezers", "tweezers"), ("beauty mirror", "beauty mirror"), ("makeup mirror", "beauty mirror"),
    ("beauty accessory", "beauty accessory"),
]
# The semantic-role style knows fewer types and tries accessories and make-up in another order.
PRODUCT_TYPES_ROLE = [
    ("lace front wig", "lace front wig"), ("lace front wigs", "lace front wig"),
    ("13x1 lace front", "lace front wig"), ("13x1 lace", "lace front wig"),
    ("deep wave", "deep wave hair extension"), ("brazilian curly", "brazilian curly hair extension"),
    ("hair weave", "hair weave"), ("hair extension", "hair extension"), ("wig", "wig"), ("wigs", "wig"),
    ("hairspray", "hairspray"), ("hair spray", "hairspray"), ("hair gel", "hair gel"),
    ("styling gel", "hair gel"), ("hair mousse", "hair mousse"),
    ("hair styling", "hair styling product"),
    ("hair clip", "hair clip"), ("hair clips", "hair clip"), ("hair claw", "hair claw clip"),
    ("hair barrette", "hair barrette"), ("hair accessory", "hair accessory"),
    ("hair accessories", "hair accessory"),
    ("automatic eyeliner", "automatic eyeliner"), ("auto eyeliner", "automatic eyeliner"),
    ("eyeliner pencil", "eyeliner pencil"), ("eyeliner", "eyeliner"), ("mascara", "mascara"),
    ("eyeshadow", "eyeshadow"), ("eye shadow", "eyeshadow"), ("eyebrow pencil", "eyebrow pencil"),
    ("lipstick", "lipstick"), ("lip stick", "lipstick"), ("lip gloss", "lip gloss"),
    ("lip balm", "lip balm"),
    ("foundation", "foundation"), ("concealer", "concealer"), ("blush", "blush"),
    ("bronzer", "bronzer"), ("face powder", "face powder"),
    ("makeup kit", "makeup kit"), ("cosmetic kit", "cosmetic kit"), ("beauty kit", "beauty kit"),
    ("makeup set", "makeup kit"),
    ("makeup brush", "makeup brush"), ("makeup brushes", "makeup brush set"),
    ("makeup sponge", "makeup sponge"), ("beauty sponge", "makeup sponge"),
    ("makeup tool", "makeup tool"),
    ("nail polish", "nail polish"), ("nail varnish", "nail polish"), ("nail lacquer", "nail polish"),
    ("perfume", "perfume"), ("cologne", "cologne"), ("fragrance", "fragrance"),
    ("deodorant", "deodorant"), ("deodarant", "deodorant"), ("antiperspirant", "antiperspirant"),
    ("anti-perspirant", "antiperspirant"),
    ("shampoo", "shampoo"), ("conditioner", "conditioner"), ("hair mask", "hair mask"),
    ("hair treatment", "hair treatment"),
    ("moisturizer", "moisturizer"), ("moisturiser", "moisturizer"), ("cleanser", "cleanser"),
    ("face cleanser", "face cleanser"), ("serum", "serum"), ("face serum", "face serum"),
    ("toner", "toner"),
    ("knitted hat", "knitted hat"), ("knitted cap", "knitted cap"),
    ("rabbit fur hat", "rabbit fur hat"), ("fur hat", "fur hat"), ("hat", "hat"), ("cap", "cap"),
    ("scarf", "scarf"), ("fashion accessory", "fashion accessory"),
    ("tweezers", "tweezers"), ("beauty mirror", "beauty mirror"), ("makeup mirror", "beauty mirror"),
    ("beauty accessory", "beauty accessory"),
]
# Descriptive English style.
PRODUCT_TYPES_DESCRIPTIVE = [
    ("eyeliner", "eyeliner"), ("mascara", "mascara"), ("lipstick", "lipstick"),
    ("foundation", "foundation"), ("concealer", "concealer"), ("blush", "blush"),
    ("eyeshadow", "eyeshadow"), ("makeup", "makeup"), ("cosmetic", "cosmetic"), ("wig", "wig"),
    ("hair extension", "hair extension"), ("hair clip", "hair clip"),
    ("hair accessory", "hair accessory"), ("hair spray", "hairspray"), ("hairspray", "hairspray"),
    ("hair gel", "hair gel"), ("hair brush", "hair brush"), ("comb", "comb"),
    ("shampoo", "shampoo"), ("conditioner", "conditioner"), ("perfume", "perfume"),
    ("cologne", "cologne"), ("deodorant", "deodorant"), ("antiperspirant", "antiperspirant"),
    ("skincare", "skincare"), ("moisturizer", "moisturizer"), ("sunscreen", "sunscreen"),
    ("cleanser", "cleanser"), ("serum", "serum"), ("nail polish", "nail polish"),
    ("nail", "nail polish"), ("makeup kit", "makeup kit"), ("beauty kit", "beauty kit"),
    ("cosmetic kit", "cosmetic kit"), ("brush", "makeup brush"), ("sponge", "makeup sponge"),
    ("mirror", "beauty mirror"), ("tweezers", "tweezers"), ("razor", "razor"), ("hat", "hat"),
    ("cap", "cap"), ("scarf", "scarf"),
]
USAGE_KEYWORDS_DESCRIPTIVE = [
    ("eye makeup", ["eye", "eyeliner", "mascara", "eyeshadow", "eyebrow"]),
    ("lip makeup", ["lip", "lipstick", "lip gloss", "lip balm"]),
    ("face makeup", ["foundation", "concealer", "blush", "powder", "bronzer"]),
    ("hair styling", ["hair spray", "hairspray", "hair gel", "hair mousse", "styling"]),
    ("hair extension", ["wig", "hair extension", "weave", "lace front"]),
    ("hair care", ["shampoo", "conditioner", "hair mask", "hair treatment"]),
    ("skincare", ["moisturizer", "cleanser", "serum", "toner", "skincare"]),
    ("fragrance", ["perfume", "cologne", "fragrance", "body spray"]),
    ("personal care", ["deodorant", "antiperspirant", "body wash", "soap"]),
    ("nail care", ["nail polish", "nail", "manicure", "pedicure"]),
    ("beauty accessories", ["brush", "sponge", "mirror", "tweezers", "accessory"]),
]
CATEGORY_BY_TYPE_DESCRIPTIVE = [
    ("eyeliner", "Beauty and Eye Makeup"), ("mascara", "Beauty and Eye Makeup"),
    ("eyeshadow", "Beauty and Eye Makeup"), ("eye makeup", "Beauty and Eye Makeup"),
    ("lipstick", "Beauty and Lip Makeup"), ("lip makeup", "Beauty and Lip Makeup"),
    ("foundation", "Beauty and Face Makeup"), ("concealer", "Beauty and Face Makeup"),
    ("blush", "Beauty and Face Makeup"), ("face makeup", "Beauty and Face Makeup"),
    ("wig", "Beauty and Hair Extensions"), ("hair extension", "Beauty and Hair Extensions"),
    ("hair clip", "Beauty and Hair Accessories"), ("hair accessory", "Beauty and Hair Accessories"),
    ("hair spray", "Beauty and Hair Styling"), ("hairspray", "Beauty and Hair Styling"),
    ("hair styling", "Beauty and Hair Styling"), ("makeup kit", "Beauty and Makeup Kits"),
    ("beauty kit", "Beauty and Makeup Kits"), ("cosmetic kit", "Beauty and Makeup Kits"),
    ("makeup brush", "Beauty and Makeup Tools"), ("makeup sponge", "Beauty and Makeup Tools"),
    ("beauty accessories", "Beauty and Makeup Tools"), ("skincare", "Beauty and Skincare"),
    ("fragrance", "Beauty and Fragrance"), ("perfume", "Beauty and Fragrance"),
    ("cologne", "Beauty and Fragrance"), ("nail polish", "Beauty and Nail Care"),
    ("nail care", "Beauty and Nail Care"), ("deodorant", "Beauty and Personal Care"),
    ("antiperspirant", "Beauty and Personal Care"), ("personal care", "Beauty and Personal Care"),
]
# Natural-sentence style: type, words that reveal it, what it is used for.
PRODUCT_TYPES_NATURAL = [
    ("eyeliner", ["eyeliner"], "eye makeup application"),
    ("mascara", ["mascara"], "eye makeup application"),
    ("lipstick", ["lipstick", "lip stick"], "lip makeup application"),
    ("foundation", ["foundation"], "face makeup application"),
    ("concealer", ["concealer"], "face makeup application"),
    ("blush", ["blush"], "face makeup application"),
    ("eyeshadow", ["eyeshadow", "eye shadow"], "eye makeup application"),
    ("wig", ["wig", "wigs"], "hair extension and styling"),
    ("hair extension", ["hair extension", "hair extensions", "weave", "lace front"],
     "hair extension and styling"),
    ("hair clip", ["hair clip", "hair clips", "hair claw", "hair barrette"],
     "hair styling and accessories"),
    ("hairspray", ["hairspray", "hair spray"], "hair styling and hold"),
    ("hair gel", ["hair gel", "styling gel"], "hair styling and hold"),
    ("makeup kit", ["makeup kit", "cosmetic kit", "beauty kit"], "cosmetic application"),
    ("makeup brush", ["makeup brush", "brush set"], "makeup application tools"),
    ("makeup sponge", ["makeup sponge", "beauty sponge"], "makeup application tools"),
    ("nail polish", ["nail polish", "nail varnish"], "nail care and decoration"),
    ("perfume", ["perfume"], "fragrance and personal scent"),
    ("cologne", ["cologne"], "fragrance and personal scent"),
    ("deodorant", ["deodorant", "deodarant"], "personal hygiene and odor control"),
    ("antiperspirant", ["antiperspirant", "anti-perspirant"], "personal hygiene and sweat control"),
    ("shampoo", ["shampoo"], "hair care and cleansing"),
    ("conditioner", ["conditioner"], "hair care and conditioning"),
    ("moisturizer", ["moisturizer", "moisturiser"], "skincare and hydration"),
    ("cleanser", ["cleanser"], "skincare and cleansing"),
    ("serum", ["serum"], "skincare treatment"),
    ("hat", ["hat", "cap"], "fashion and sun protection"),
    ("scarf", ["scarf"], "fashion accessory"),
    ("beauty accessory", ["accessory", "accessories", "tweezers", "mirror"],
     "beauty and grooming tools"),
]
CATEGORY_BY_USE_NATURAL = [
    ("eye makeup", "Beauty and Eye Makeup"),
    ("lip makeup", "Beauty and Lip Makeup"),
    ("face makeup", "Beauty and Face Makeup"),
    ("cosmetic application", "Beauty and Face Makeup"),
    ("hair extension", "Beauty and Hair Extensions"),
    ("hair styling and accessories", "Beauty and Hair Accessories"),
    ("hair styling", "Beauty and Hair Styling"),
    ("makeup application tools", "Beauty and Makeup Tools"),
    ("nail care", "Beauty and Nail Care"),
    ("fragrance", "Beauty and Fragrance"),
    ("skincare", "Beauty and Skincare"),
    ("hair care", "Beauty and Hair Care"),
    ("personal hygiene", "Beauty and Personal Care"),
    ("fashion", "Beauty and Fashion Accessories"),
]

FALLBACK_CATEGORY = "Beauty Products"
CATEGORY_BY_TYPE = [
    ("eyeliner", "Beauty and Eye Makeup"), ("mascara", "Beauty and Eye Makeup"),
    ("eyeshadow", "Beauty and Eye Makeup"), ("eye makeup", "Beauty and Eye Makeup"),
    ("lipstick", "Beauty and Lip Makeup"), ("lip makeup", "Beauty and Lip Makeup"),
    ("foundation", "Beauty and Face Makeup"), ("concealer", "Beauty and Face Makeup"),
    ("blush", "Beauty and Face Makeup"), ("face makeup", "Beauty and Face Makeup"),
    ("wig", "Beauty and Hair Extensions"), ("lace front wig", "Beauty and Hair Extensions"),
    ("hair extension", "Beauty and Hair Extensions"), ("hair clip", "Beauty and Hair Accessories"),
    ("hair accessory", "Beauty and Hair Accessories"), ("headband", "Beauty and Hair Accessories"),
    ("scrunchie", "Beauty and Hair Accessories"), ("hair spray", "Beauty and Hair Styling"),
    ("hairspray", "Beauty and Hair Styling"), ("hair gel", "Beauty and Hair Styling"),
    ("gel", "Beauty and Hair Styling"), ("hair styling", "Beauty and Hair Styling"),
    ("makeup kit", "Beauty and Makeup Kits"), ("beauty kit", "Beauty and Makeup Kits"),
    ("cosmetic kit", "Beauty and Makeup Kits"), ("makeup brush", "Beauty and Makeup Tools"),
    ("makeup sponge", "Beauty and Makeup Tools"), ("beauty accessories", "Beauty and Makeup Tools"),
    ("shampoo", "Beauty and Hair Care"), ("conditioner", "Beauty and Hair Care"),
    ("hair care", "Beauty and Hair Care"), ("skincare", "Beauty and Skincare"),
    ("cream", "Beauty and Skincare"), ("lotion", "Beauty and Skincare"),
    ("serum", "Beauty and Skincare"), ("fragrance", "Beauty and Fragrance"),
    ("perfume", "Beauty and Fragrance"), ("cologne", "Beauty and Fragrance"),
    ("nail polish", "Beauty and Nail Care"), ("gel nail", "Beauty and Nail Care"),
    ("nail care", "Beauty and Nail Care"), ("deodorant", "Beauty and Personal Care"),
    ("antiperspirant", "Beauty and Personal Care"), ("personal care", "Beauty and Personal Care"),
    ("default", "Beauty Products"),
]

# --- attributes ----------------------------------------------------------------------
NULL_LIKE = ["null", "none", "n/a", "unknown", ""]
SEMANTIC_DETAIL_KEYS = [
    "Item Form", "Material", "Hair Type", "Finish Type", "Coverage", "Skin Type", "Scent", "Color",
    "Installation Type",
]
MAX_DETAIL_LENGTH = 100
ATTRIBUTE_PRIORITY = ["Item Form", "Material", "Finish Type", "Color", "Coverage", "Skin Type"]
DESCRIPTION_MARKETING_WORDS = ["gift", "perfect", "women", "girls"]
TYPE_SENTENCES = {
    "beard straightener": "Heated beard straightener for hair styling.",
    "hair straightener": "Hair straightener for styling.",
    "heated hair brush": "Heated hair brush for styling.",
    "hair dryer": "Hair dryer for styling.",
    "hair curler": "Hair curler for styling.",
    "wig": "Wig for hair styling.",
    "lace front wig": "Lace front wig for natural hairline.",
    "hair extension": "Hair extension for adding length and volume.",
    "tape-in hair extension": "Tape-in hair extension.",
    "clip-in hair extension": "Clip-in hair extension.",
    "scrunchie": "Scrunchie hair accessory.",
    "headband": "Headband hair accessory.",
    "hair clip": "Hair clip accessory.",
    "hair claw clip": "Hair claw clip accessory.",
    "hair barrette": "Hair barrette accessory.",
    "foundation": "Foundation makeup product.",
    "concealer": "Concealer makeup product.",
    "lipstick": "Lipstick makeup product.",
    "lip gloss": "Lip gloss makeup product.",
    "lip balm": "Lip balm for lip care.",
    "eyeliner": "Eyeliner makeup product.",
    "automatic eyeliner": "Automatic eyeliner for precise application.",
    "eyeliner pencil": "Eyeliner pencil for eye makeup.",
    "mascara": "Mascara for eyelash enhancement.",
    "eyeshadow": "Eyeshadow for eye makeup.",
    "eyebrow pencil": "Eyebrow pencil for eyebrow definition.",
    "eyebrow product": "Eyebrow makeup product.",
    "face paint": "Face paint for creative makeup.",
    "nail polish": "Nail polish for nail decoration.",
    "gel nail": "Gel nail polish.",
    "acrylic nail": "Acrylic nail product.",
    "fake nail": "Fake nail product.",
    "cream": "Cream skincare product.",
    "gel": "Gel skincare product.",
    "serum": "Serum skincare product.",
    "face serum": "Face serum for skincare.",
    "lotion": "Lotion skincare product.",
    "cleanser": "Cleanser for skincare.",
    "face cleanser": "Face cleanser for skincare.",
    "toner": "Toner for skincare.",
    "mask": "Face mask for skincare.",
    "face mask": "Face mask for skincare.",
    "hair mask": "Hair mask for hair care.",
    "moisturizer": "Moisturizer for skincare.",
    "shampoo": "Shampoo for hair care.",
    "conditioner": "Conditioner for hair care.",
    "hair treatment": "Hair treatment product.",
}

# --- semantic roles ------------------------------------------------------------------
# type -> (primary use, functional role, category)
SEMANTIC_ROLES = {
    "eyeliner": ("eye makeup application", "defining and enhancing eye appearance", "Beauty and Eye Makeup"),
    "automatic eyeliner": ("eye makeup application", "defining and enhancing eye appearance with precision", "Beauty and Eye Makeup"),
    "eyeliner pencil": ("eye makeup application", "defining and enhancing eye appearance", "Beauty and Eye Makeup"),
    "mascara": ("eye makeup application", "enhancing eyelash length and volume", "Beauty and Eye Makeup"),
    "eyeshadow": ("eye makeup application", "adding color and dimension to eyelids", "Beauty and Eye Makeup"),
    "eyebrow pencil": ("eye makeup application", "defining and shaping eyebrow appearance", "Beauty and Eye Makeup"),
    "lipstick": ("lip makeup application", "adding color and definition to lips", "Beauty and Lip Makeup"),
    "lip gloss": ("lip makeup application", "adding shine and color to lips", "Beauty and Lip Makeup"),
    "lip balm": ("lip care and protection", "moisturizing and protecting lips", "Beauty and Lip Makeup"),
    "foundation": ("face makeup application", "creating even skin tone and coverage", "Beauty and Face Makeup"),
    "concealer": ("face makeup application", "covering imperfections and blemishes", "Beauty and Face Makeup"),
    "blush": ("face makeup application", "adding color and dimension to cheeks", "Beauty and Face Makeup"),
    "bronzer": ("face makeup application", "adding warmth and contour to face", "Beauty and Face Makeup"),
    "face powder": ("face makeup application", "setting makeup and reducing shine", "Beauty and Face Makeup"),
    "wig": ("hair extension and cosmetic styling", "creating a natural hairstyle for beauty and fashion", "Beauty and Hair Extensions"),
    "lace front wig": ("hair extension and cosmetic styling", "creating a natural hairstyle with realistic hairline", "Beauty and Hair Extensions"),
    "hair extension": ("hair extension and cosmetic styling", "adding length and volume to natural hair", "Beauty and Hair Extensions"),
    "deep wave hair extension": ("hair extension and cosmetic styling", "creating deep wave hairstyle with extensions", "Beauty and Hair Extensions"),
    "brazilian curly hair extension": ("hair extension and cosmetic styling", "creating curly hairstyle with Brazilian hair extensions", "Beauty and Hair Extensions"),
    "hair weave": ("hair extension and cosmetic styling", "adding length and volume through weaving technique", "Beauty and Hair Extensions"),
    "hairspray": ("hair styling and hold", "maintaining hairstyle shape and preventing frizz", "Beauty and Hair Styling"),
    "hair gel": ("hair styling and hold", "shaping and holding hair in desired style", "Beauty and Hair Styling"),
    "hair mousse": ("hair styling and hold", "adding volume and texture to hair", "Beauty and Hair Styling"),
    "hair styling product": ("hair styling and hold", "shaping and maintaining hairstyle", "Beauty and Hair Styling"),
    "hair clip": ("hair styling and accessories", "securing and styling hair in place", "Beauty and Hair Accessories"),
    "hair claw clip": ("hair styling and accessories", "securing hair with claw-style grip", "Beauty and Hair Accessories"),
    "hair barrette": ("hair styling and accessories", "decorative hair securing accessory", "Beauty and Hair Accessories"),
    "hair accessory": ("hair styling and accessories", "decorating and securing hair", "Beauty and Hair Accessories"),
    "makeup kit": ("cosmetic application", "providing multiple makeup products for complete application", "Beauty and Makeup Kits"),
    "cosmetic kit": ("cosmetic application", "providing multiple cosmetic products for complete application", "Beauty and Makeup Kits"),
    "beauty kit": ("cosmetic application", "providing multiple beauty products for complete application", "Beauty and Makeup Kits"),
    "makeup brush": ("makeup application tools", "applying and blending makeup products", "Beauty and Makeup Tools"),
    "makeup brush set": ("makeup application tools", "providing multiple brushes for various makeup applications", "Beauty and Makeup Tools"),
    "makeup sponge": ("makeup application tools", "blending and applying liquid and cream makeup", "Beauty and Makeup Tools"),
    "makeup tool": ("makeup application tools", "aiding in makeup application process", "Beauty and Makeup Tools"),
    "nail polish": ("nail care and decoration", "adding color and protection to nails", "Beauty and Nail Care"),
    "nail varnish": ("nail care and decoration", "adding color and protection to nails", "Beauty and Nail Care"),
    "perfume": ("fragrance and personal scent", "providing pleasant scent for personal use", "Beauty and Fragrance"),
    "cologne": ("fragrance and personal scent", "providing pleasant scent for personal use", "Beauty and Fragrance"),
    "fragrance": ("fragrance and personal scent", "providing pleasant scent for personal use", "Beauty and Fragrance"),
    "deodorant": ("personal hygiene and odor control", "preventing body odor and maintaining freshness", "Beauty and Personal Care"),
    "antiperspirant": ("personal hygiene and sweat control", "reducing perspiration and preventing body odor", "Beauty and Personal Care"),
    "shampoo": ("hair care and cleansing", "cleaning and maintaining hair health", "Beauty and Hair Care"),
    "conditioner": ("hair care and conditioning", "moisturizing and detangling hair", "Beauty and Hair Care"),
    "hair mask": ("hair care and treatment", "deep conditioning and repairing hair", "Beauty and Hair Care"),
    "hair treatment": ("hair care and treatment", "repairing and improving hair condition", "Beauty and Hair Care"),
    "moisturizer": ("skincare and hydration", "moisturizing and protecting skin", "Beauty and Skincare"),
    "cleanser": ("skincare and cleansing", "removing dirt and impurities from skin", "Beauty and Skincare"),
    "face cleanser": ("skincare and cleansing", "removing dirt and impurities from facial skin", "Beauty and Skincare"),
    "serum": ("skincare treatment", "targeted treatment for specific skin concerns", "Beauty and Skincare"),
    "face serum": ("skincare treatment", "targeted treatment for facial skin concerns", "Beauty and Skincare"),
    "toner": ("skincare treatment", "balancing skin pH and preparing for other products", "Beauty and Skincare"),
    "hat": ("fashion accessory for everyday wear", "appearance enhancement and casual fashion", "Beauty and Fashion Accessories"),
    "knitted hat": ("fashion accessory for everyday wear", "warmth and appearance enhancement", "Beauty and Fashion Accessories"),
    "knitted cap": ("fashion accessory for everyday wear", "warmth and appearance enhancement", "Beauty and Fashion Accessories"),
    "rabbit fur hat": ("fashion accessory for everyday wear", "luxury appearance enhancement and warmth", "Beauty and Fashion Accessories"),
    "fur hat": ("fashion accessory for everyday wear", "luxury appearance enhancement and warmth", "Beauty and Fashion Accessories"),
    "cap": ("fashion accessory for everyday wear", "appearance enhancement and casual fashion", "Beauty and Fashion Accessories"),
    "scarf": ("fashion accessory for everyday wear", "appearance enhancement and fashion styling", "Beauty and Fashion Accessories"),
    "fashion accessory": ("fashion accessory for everyday wear", "appearance enhancement and fashion styling", "Beauty and Fashion Accessories"),
    "tweezers": ("beauty and grooming tools", "precise hair removal and grooming", "Beauty and Makeup Tools"),
    "beauty mirror": ("beauty and grooming tools", "aiding in makeup application and grooming", "Beauty and Makeup Tools"),
    "makeup mirror": ("beauty and grooming tools", "aiding in makeup application and grooming", "Beauty and Makeup Tools"),
    "beauty accessory": ("beauty and grooming tools", "aiding in beauty and grooming routines", "Beauty and Makeup Tools"),
    "default": ("beauty and personal care", "enhancing personal appearance and care", "Beauty Products"),
}
STRONG_ATTRIBUTES = [
    "automatic", "auto", "pencil", "gel", "liquid", "cream", "powder",
    "lace front", "13x1", "deep wave", "brazilian", "curly", "straight",
    "knitted", "rabbit fur", "human hair", "synthetic", "real fur",
    "unscented", "scented", "waterproof", "long lasting", "matte", "glossy",
    "pre plucked", "baby hair", "density", "pack of",
]
STRONG_MATERIALS = ["human hair", "synthetic", "rabbit fur", "real fur"]
STRONG_FORMS = ["pencil", "gel", "liquid", "cream", "powder"]

# --- field-labelled text -------------------------------------------------------------
LABEL_TITLE = "Tên sản phẩm"
LABEL_CATEGORY = "Danh mục"
LABEL_BRAND = "Thương hiệu"
LABEL_ATTRIBUTES = "Thuộc tính chính"
LABELLED_KEYS = [
    "material", "material_type", "material type", "product_form", "product form", "form",
    "style", "design", "use", "usage", "purpose", "target_audience", "target audience", "audience",
    "type", "category", "size", "color", "colour", "features", "feature", "benefits", "benefit",
]
LABELLED_EXCLUDED = [
    "asin", "url", "image", "video", "price", "rating", "review", "id",
    "is_discontinued", "discontinued", "manufacturer", "dimensions",
    "weight", "package", "shipping", "warranty", "date", "time",
    "product_dimensions", "item_model_number", "model_number",
]
DESCRIPTIVE_KEYS = [
    "material", "material type", "form", "product form", "item form", "style", "design", "type",
    "color", "colour", "size", "skin type", "hair type", "age range", "target audience",
]
NATURAL_KEYS = ["material", "material type", "form", "product form", "color", "colour", "style"]

# --- text cleaning -------------------------------------------------------------------
PROMO_PHRASES = [
    "chất lượng cao", "sản phẩm tuyệt vời", "uy tín", "đáng tin cậy", "giá rẻ", "giá tốt",
    "khuyến mãi", "giảm giá", "hot deal", "best seller", "bán chạy", "phổ biến",
    "được yêu thích", "được đánh giá cao", "5 sao", "★★★★★",
]
UNIMPORTANT_KEY_PARTS = ["unit", "count", "dimension", "weight", "package"]
LOWER_LETTERS = (
    "a-zàáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ"
)
MAX_TEXT = 500
