"""Source and source type of a data type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Data type = source, source type.
SOURCES = {
    "fs:stat": ("FILE", "File stat"),
    "fs:stat:ntfs": ("FILE", "NTFS File stat"),
    "fs:ntfs:usn_change": ("FILE", "NTFS USN Change"),
    "fs:bodyfile:entry": ("FILE", "Bodyfile Entry"),
    "fs:mactime:line": ("FILE", "Mactime Line"),
    "fs:stat:ext": ("FILE", "EXT File stat"),
    "fs:stat:hfs": ("FILE", "HFS File stat"),
    "windows:registry:key_value": ("REG", "Registry Key"),
    "windows:registry:appcompatcache": ("REG", "AppCompatCache"),
    "windows:registry:bagmru": ("REG", "BagMRU"),
    "windows:registry:bam": ("REG", "BAM/DAM"),
    "windows:registry:mrulist": ("REG", "MRUList Registry"),
    "windows:registry:mrulistex": ("REG", "MRUListEx Registry"),
    "windows:registry:msie_zone": ("REG", "MSIE Zone Settings"),
    "windows:registry:mount_points2": ("REG", "Mount Points"),
    "windows:registry:networks": ("REG", "Networks Registry"),
    "windows:registry:run": ("REG", "Run/RunOnce Registry"),
    "windows:registry:sam_users": ("REG", "SAM Users"),
    "windows:registry:services": ("REG", "Services Registry"),
    "windows:registry:shutdown": ("REG", "Shutdown Registry"),
    "windows:registry:timezone": ("REG", "Timezone Registry"),
    "windows:registry:typedurls": ("REG", "TypedURLs Registry"),
    "windows:registry:userassist": ("REG", "UserAssist Registry"),
    "windows:registry:usb": ("REG", "USB Registry"),
    "windows:registry:winlogon": ("REG", "Winlogon Registry"),
    "windows:evt:record": ("EVT", "WinEVT"),
    "windows:evtx:record": ("EVT", "WinEVTX"),
    "chrome:history:file_downloaded": ("WEBHIST", "Chrome History"),
    "chrome:history:page_visited": ("WEBHIST", "Chrome History"),
    "chrome:cache:entry": ("WEBHIST", "Chrome Cache"),
    "chrome:cookie:entry": ("WEBHIST", "Chrome Cookies"),
    "chrome:autofill:entry": ("WEBHIST", "Chrome Autofill"),
    "firefox:places:bookmark": ("WEBHIST", "Firefox History"),
    "firefox:places:bookmark_annotation": ("WEBHIST", "Firefox History"),
    "firefox:places:bookmark_folder": ("WEBHIST", "Firefox History"),
    "firefox:places:page_visited": ("WEBHIST", "Firefox History"),
    "firefox:downloads:download": ("WEBHIST", "Firefox Downloads"),
    "firefox:cache:record": ("WEBHIST", "Firefox Cache"),
    "firefox:cookie:entry": ("WEBHIST", "Firefox Cookies"),
    "msiecf:leak": ("WEBHIST", "MSIE CF"),
    "msiecf:redirected": ("WEBHIST", "MSIE CF"),
    "msiecf:url": ("WEBHIST", "MSIE CF"),
    "msie:webcache:container": ("WEBHIST", "MSIE WebCache"),
    "msie:webcache:containers": ("WEBHIST", "MSIE WebCache"),
    "msie:webcache:leak": ("WEBHIST", "MSIE WebCache"),
    "opera:history:entry": ("WEBHIST", "Opera History"),
    "opera:history:typed_entry": ("WEBHIST", "Opera History"),
    "safari:history:visit": ("WEBHIST", "Safari History"),
    "syslog:line": ("LOG", "Syslog"),
    "syslog:comment": ("LOG", "Syslog"),
    "syslog:cron:task_run": ("LOG", "Syslog Cron"),
    "syslog:ssh:login": ("LOG", "Syslog SSH"),
    "syslog:ssh:failed_connection": ("LOG", "Syslog SSH"),
    "syslog:ssh:opened_connection": ("LOG", "Syslog SSH"),
    "bash:history:command": ("LOG", "Bash History"),
    "apt:history:line": ("LOG", "APT History"),
    "selinux:line": ("LOG", "SELinux"),
    "mac:appfirewall:line": ("LOG", "Mac AppFirewall"),
    "mac:wifi:line": ("LOG", "Mac Wifi"),
    "android:logcat": ("LOG", "Android Logcat"),
    "olecf:dest_list:entry": ("OLECF", "OLECF Dest List"),
    "olecf:document_summary_info": ("OLECF", "OLECF Document Summary"),
    "olecf:summary_info": ("OLECF", "OLECF Summary Info"),
    "olecf:item": ("OLECF", "OLECF Item"),
    "windows:lnk:link": ("LNK", "Windows Shortcut"),
    "windows:prefetch:execution": ("PREFETCH", "Windows Prefetch"),
    "pe_coff:file": ("PE", "PE File"),
    "pe:compilation:timestamp": ("PE", "PE Compilation Time"),
    "pe:import:timestamp": ("PE", "PE Import Time"),
    "pe:delay_import:timestamp": ("PE", "PE Delay Import Time"),
    "skype:event:call": ("LOG", "Skype"),
    "skype:event:chat": ("LOG", "Skype"),
    "skype:event:account": ("LOG", "Skype"),
    "skype:event:transferfile": ("LOG", "Skype"),
    "windows:metadata:deleted_item": ("RECBIN", "Recycle Bin"),
    "task_scheduler:task_cache:entry": ("TASK", "Task Scheduler"),
    "plist:key": ("PLIST", "Plist Key"),
    "mac:notificationcenter:db": ("PLIST", "Notification Center"),
    "systemd:journal": ("LOG", "Systemd Journal"),
    "windows:tasks:job": ("TASK", "Windows Job"),
    "windows:restore_point:info": ("RP", "Restore Point"),
    "popularity_contest:session:event": ("LOG", "Popularity Contest"),
    "popularity_contest:log:event": ("LOG", "Popularity Contest"),
    "macos:fseventsd:record": ("LOG", "macOS FSEvents"),
    "macos:spotlight_store:entry": ("LOG", "macOS Spotlight"),
}


def source_of(data_type: Column) -> Column:
    """struct(source, sourcetype): by the whole type, by its first two parts, else made from the type."""
    known = F.create_map(*[x for k, (s, t) in SOURCES.items() for x in (F.lit(k), F.struct(F.lit(s).alias("source"), F.lit(t).alias("sourcetype")))])
    made = F.struct(F.upper(F.substring_index(data_type, ":", 1)).alias("source"), data_type.alias("sourcetype"))
    return F.coalesce(F.try_element_at(known, data_type), F.try_element_at(known, F.substring_index(data_type, ":", 2)), made)
