"""Fixed values of the domain: thresholds, label names and the spellings that key-field rules look for."""

from __future__ import annotations

# Detection, OCR and matching thresholds.
DETECTION_CONFIDENCE, DETECTION_IOU = 0.25, 0.45
MIN_OCR_CONFIDENCE, REGION_OCR_CONFIDENCE = 0.05, 0.3
CROP_PADDING = 4
DEDUP_IOU, ALIGN_IOU, FIELD_IOU = 0.80, 0.10, 0.15
AP_THRESHOLDS = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)
LINE_TOLERANCE, LINE_SHARE = 8, 0.60
READING_BUCKET = 50
VAT_RATE = "0.15"
PRODUCTS_PER_INVOICE, PRODUCTS_SPREAD = 5, 0.4
MAX_SIDE = 4000
SPLIT_SEED = 42
SPLITS = {"train": "0.7", "val": "0.2", "test": "0.1"}

# Image suffixes; the first ones found win where a stem has several.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp")
SUFFIX_PRIORITY = (".jpg", ".jpeg", ".png")
SUFFIX_PRIORITY_CORRECTED = (".png", ".jpg", ".jpeg")

# The model's label of each field that annotators name.
MODEL_LABELS = {
    "invoice_number": "INVOICE_NUMBER",
    "invoice_ref": "INVOICE_NUMBER",
    "offer_number": "INVOICE_NUMBER",
    "issue_date": "INVOICE_DATE",
    "issue_datetime": "INVOICE_DATE",
    "hijri_date": "INVOICE_DATE",
    "issue_time": "INVOICE_TIME",
    "document_type": "INVOICE_TYPE",
    "invoice_type": "INVOICE_TYPE",
    "payment_type": "INVOICE_TYPE",
    "branch_name": "BRANCH",
    "warehouse": "BRANCH",
    "page_number": "PAGE_NUMBER",
    "customer_name": "CUSTOMER_NAME",
    "recipient_name": "CUSTOMER_NAME",
    "recipient_company": "CUSTOMER_NAME",
    "customer_vat_number": "CUSTOMER_VAT",
    "recipient_vat_number": "CUSTOMER_VAT",
    "customer_number": "CUSTOMER_NUMBER",
    "customer_phone": "CUSTOMER_PHONE",
    "recipient_phone": "CUSTOMER_PHONE",
    "street_address": "CUSTOMER_ADDRESS",
    "vendor_name_ar": "COMPANY_NAME",
    "vendor_name_en": "COMPANY_NAME",
    "vendor_activity": "COMPANY_NAME",
    "company_name": "COMPANY_NAME",
    "vendor_address_en": "SELLER_ADDRESS",
    "seller_address": "SELLER_ADDRESS",
    "vendor_vat_number": "SELLER_VAT",
    "seller_vat_number": "SELLER_VAT",
    "vendor_cr_number": "SELLER_VAT",
    "vendor_phone": "SELLER_PHONE",
    "vendor_admin_phone": "SELLER_PHONE",
    "seller_name": "SELLER_NAME",
    "subtotal": "SUBTOTAL",
    "discount": "DISCOUNT",
    "net_amount": "NET_AMOUNT",
    "vat_amount": "TAX",
    "vat_rate": "TAX",
    "tax": "TAX",
    "grand_total": "TOTAL",
    "total": "TOTAL",
    "total_amount": "TOTAL",
    "vat_taxable_qty": "TAX",
    "email": "EMAIL",
    "website": "WEBSITE",
    "instructions": "INSTRUCTIONS",
}

# Words that mark a key field on the token before it. TOTAL is spelt in visual order.
SELLER, NAME, TAX, INVOICE, NUMBER, DATE, TOTAL = "البائع", "اسم", "ضريبة", "فاتورة", "رقم", "تاريخ", "اإلجمالي"
CURRENCY = "ريال"

# Chances of each image effect, and of the geometric branches.
EFFECT_CHANCES = {
    "thermal_print": 0.85,
    "texture": 0.9,
    "fold": 0.3,
    "coffee_stain": 0.15,
    "wrinkles": 0.4,
    "ink_bleed": 0.3,
    "blur": 0.85,
    "jpeg_artifacts": 0.9,
    "noise": 0.8,
    "distortion": 0.2,
    "color_jitter": 0.9,
    "shadow": 0.8,
}
PERSPECTIVE_CHANCE, ROTATION_CHANCE = 0.3, 0.6
PERSPECTIVE_DECAY, ROTATION_DECAY = 0.95, 0.9
