"""What a caller reads of an error: its code, a message and what to do about it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code -> (message, what to do). The codes are fixed values of the contract.
ERRORS = {
    "FILE_NOT_FOUND": ("There is no such file.", "Check the spelling; relative paths start at an allowed folder."),
    "PATH_NOT_ALLOWED": ("The path is outside the folders that may be read.", "Name a file below an allowed folder, or allow its folder in the settings."),
    "NOT_A_REGULAR_FILE": ("The path does not name a regular file.", "Name a file, not a folder or a device."),
    "UNSUPPORTED_MEDIA_TYPE": ("Files of this type are not processed.", "Convert the file to a document, image or text first."),
    "FILE_TOO_LARGE": ("The file or image is over the size limit.", "Split or scale it down, or raise max_file_mb or max_image_pixels if the source is trusted."),
    "INVALID_PAGE_SELECTION": ("The page selection cannot be read or selects nothing.", "Write pages as 3, 1-5 or 1,3,8-10, counted from 1."),
    "INVALID_ARGUMENT": ("An argument has a value that is not known.", "Use mode auto, document, ocr or vision; detail compact, normal or full; vision_profile auto or a listed one; and a plain path."),
    "MODE_NOT_APPLICABLE": ("The mode does not fit this kind of file.", "Use mode auto."),
    "OCR_NOT_CONFIGURED": ("No OCR engine is available.", "Give the engine an OCR backend."),
    "OCR_FAILED": ("The OCR engine failed on this image.", "Try again, or use mode vision if it is allowed."),
    "VISION_NOT_CONFIGURED": ("No vision provider is configured.", "Set vision_base_url, vision_api_key and vision_model, or use mode ocr."),
    "CLOUD_VISION_DISABLED": ("Nothing may be sent to the vision provider.", "Set allow_cloud_vision if images may leave this place, or use mode ocr."),
    "VISION_AUTHENTICATION_FAILED": ("The vision provider did not accept the key.", "Check vision_api_key."),
    "VISION_PERMISSION_DENIED": ("The key may not use this model.", "Ask the provider for access, or choose another model."),
    "VISION_QUOTA_EXCEEDED": ("The quota at the vision provider is used up.", "Add credit or wait until the quota is renewed."),
    "VISION_RATE_LIMITED": ("The vision provider limits the rate of requests.", "Wait and send fewer; it was not tried again at once."),
    "VISION_MODEL_UNAVAILABLE": ("The model or its address is not available.", "Check vision_model and vision_base_url; no other model was used instead."),
    "VISION_PROVIDER_TIMEOUT": ("The vision provider did not answer in time.", "Try again, or raise vision_timeout_seconds."),
    "VISION_EMPTY_RESPONSE": ("The vision provider answered with nothing.", "Try another model, or mode ocr; this is not stored."),
    "VISION_INVALID_RESPONSE": ("The vision provider's answer has an unknown form.", "Check that the address serves chat completions."),
    "VISION_PROVIDER_ERROR": ("The vision provider refused or lost the request.", "Check that the model takes images, and the connection."),
    "DOCUMENT_CONVERSION_FAILED": ("The document could not be converted.", "Check that it opens elsewhere and has no password."),
    "IMAGE_DECODE_FAILED": ("The image could not be decoded or prepared.", "Export it again, as PNG if possible."),
    "PROCESSING_TIMEOUT": ("Processing took longer than allowed.", "Ask for fewer pages, or raise process_timeout_seconds."),
    "CACHE_ERROR": ("The cache could not be used.", "Check its folder."),
    "CONFIGURATION_ERROR": ("The settings are not valid.", "Run the doctor command."),
    "INTERNAL_ERROR": ("Something failed that should not.", "Try again; if it stays, report the request."),
}
#: Reasons and advice for categories that are refused.
REFUSED_HINTS = {"archive": "Unpack the archive and name the file in it that is needed; archives are not opened, since small ones can unpack to any size.", "audio": "Transcribe it with another tool and pass the text."}


def error_struct(code: Column, reason: Column, category: Column) -> Column:
    """struct<code, message, hint>; a refused category has its own reason and hint. Null where there is no code."""
    message, hint = F.lit(ERRORS["INTERNAL_ERROR"][0]), F.lit(ERRORS["INTERNAL_ERROR"][1])
    for name, (said, advice) in ERRORS.items():
        message, hint = F.when(code == name, said).otherwise(message), F.when(code == name, advice).otherwise(hint)
    refused = code == "UNSUPPORTED_MEDIA_TYPE"
    for name, advice in REFUSED_HINTS.items():
        hint = F.when(refused & (category == name), advice).otherwise(hint)
    return F.when(code.isNotNull(), F.struct(code.alias("code"), F.coalesce(F.when(refused, reason), message).alias("message"), hint.alias("hint")))


def error_markdown(error: Column) -> Column:
    return F.concat(F.lit("## Error: "), error["code"], F.lit("\n\n"), error["message"], F.lit("\n\n**What to do:** "), error["hint"])
