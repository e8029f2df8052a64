"""One flat list of the public operators, under the names that imaging users look for."""
from __future__ import annotations

from .functions.color import (
    aces2065_1_to_acescct, aces2065_1_to_acescg, acescct_to_aces2065_1, acescg_to_aces2065_1, bgr_to_grayscale, bgr_to_hsv, bgr_to_rgb, bgr_to_ycbcr,
    hsv_to_bgr, hsv_to_rgb, rgb_to_bgr, rgb_to_grayscale, rgb_to_hsv, rgb_to_ycbcr, ycbcr_full_to_legal, ycbcr_legal_to_full, ycbcr_to_bgr, ycbcr_to_grayscale, ycbcr_to_rgb,
)
from .functions.dtype import to_dtype, to_float16, to_float32, to_float64, to_uint8, to_uint16
from .functions.sql import register as register_sql_functions
from .operators.affine import affine_transform, affine_transform_by, crop_from_kps, get_inverse_matrix
from .operators.arrays import batch_to_tile, blur_images, images_to_pixels, pixels_to_images, resize_images, to_batch, to_blobs
from .operators.chroma import ndi_uyvy422_to_ycbcr444, ndi_uyvy422_to_ycbcr444_resized, uyvy422_to_ycbcr444, yuv420p_to_ycbcr444, yuv420p_to_ycbcr444_resized, yuv422p10le_to_ycbcr444
from .operators.faces import align, detect, records, swap
from .operators.filters import GaussianBlur, create_erode_kernel, create_gaussian_kernel, erode, gaussian_blur
from .operators.infer import embed, upscale
from .operators.lut import aces2065_1_to_rec709, apply_lut, rec709_to_aces2065_1
from .operators.resample import resize
from .operators.tiles import add_padding, create_gaussian_weights, merge_tiles, tile_image
from .operators.vision import PasteBack, latent, letterbox, nms, paste_back, to_blob
from .schema import AREA as INTER_AREA
from .schema import AUTO as INTER_AUTO
from .schema import B_SPLINE as INTER_B_SPLINE
from .schema import CATMULL_ROM as INTER_CATMULL_ROM
from .schema import CUBIC as INTER_CUBIC
from .schema import FACE as Face
from .schema import LANCZOS2 as INTER_LANCZOS2
from .schema import LANCZOS3 as INTER_LANCZOS3
from .schema import LANCZOS4 as INTER_LANCZOS4
from .schema import LINEAR as INTER_LINEAR
from .schema import MITCHELL as INTER_MITCHELL
from .schema import NEAREST as INTER_NEAREST
from .sources.cube import read_lut
from .sources.images import imread, imwrite, preview

__all__ = [n for n in dir() if not n.startswith("_") and n != "annotations"]
